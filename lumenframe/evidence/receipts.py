"""A run writes what it read, produced and sealed into a receipt that can be checked later."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArtifactRefusal, ClockRefusal, LedgerRefusal
from ..streaming.batches import sha256_of

FORMAT = "lumenframe.receipt.v1"


def canonical(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(value) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def frame_digest(df: DataFrame) -> dict:
    """Row count and an order-free digest of a DataFrame's content, from one aggregate."""
    h = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    word = lambda i: F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    row = df.agg(F.count("*").alias("n"), *[F.sum(word(i)).alias(f"w{i}") for i in range(5)]).first()
    return {"rows": row["n"], "content": digest([str(row[f"w{i}"]) for i in range(5)]), "columns": sorted(df.columns)}


class Ledger:
    """A file of JSON lines, each with the hash of the one before."""

    def __init__(self, path: str):
        self.path = path
        self._tail: tuple[int, int, str] | None = None

    def entries(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return [json.loads(line) for line in f]

    def append(self, event: dict) -> dict:
        """Audits what it has not seen: the whole file, unless its end is where this ledger's last append left it."""
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        if self._tail is None or self._tail[0] != size:
            past = self.audit()
            self._tail = (size, len(past), past[-1]["hash"] if past else "0" * 64)
        body = {"index": self._tail[1], "previous": self._tail[2], "event": event}
        entry = body | {"hash": digest(body)}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(canonical(entry).decode() + "\n")
            f.flush()
            os.fsync(f.fileno())
            self._tail = (f.tell(), body["index"] + 1, entry["hash"])
        return entry

    def audit(self) -> list[dict]:
        found, previous = self.entries(), "0" * 64
        for i, e in enumerate(found):
            body = {k: e[k] for k in ("index", "previous", "event")}
            if e["index"] != i or e["previous"] != previous or e["hash"] != digest(body):
                raise LedgerRefusal(f"entry {i} breaks the chain")
            previous = e["hash"]
        return found


class Run:
    """Context of a run: records inputs, seals, outputs, one clock reading, and writes the receipt at its end."""

    def __init__(self, folder: str, name: str, ledger: Ledger | None = None):
        self.id = f"{name}-{uuid.uuid4().hex[:12]}"
        self.folder = os.path.join(folder, self.id)
        os.makedirs(self.folder)
        self.ledger = ledger
        self.body: dict = {"format": FORMAT, "run": self.id, "inputs": {}, "outputs": {}, "seals": {}, "plans": {}, "clock": {}, "status": "open"}

    def input(self, path: str) -> str:
        if os.path.islink(path):
            raise ArtifactRefusal(f"{path} is a link")
        self.body["inputs"][os.path.abspath(path)] = sha256_of(path)
        return path

    def output(self, path: str) -> str:
        self.body["outputs"][os.path.abspath(path)] = sha256_of(path)
        return path

    def seal(self, name: str, value) -> None:
        """A name is sealed once, with a value or a DataFrame."""
        if name in self.body["seals"]:
            raise ArtifactRefusal(f"{name} is sealed")
        if isinstance(value, DataFrame):
            self.body["plans"][name] = value._jdf.queryExecution().optimizedPlan().toString()
            value = frame_digest(value)
        self.body["seals"][name] = value

    def time_date(self, mode: str = "utc") -> str:
        """Wall-clock text, read once a run and mode."""
        if mode not in ("utc", "local"):
            raise ClockRefusal(f"mode {mode}")
        if mode not in self.body["clock"]:
            now = datetime.datetime.now(datetime.UTC if mode == "utc" else None)
            self.body["clock"][mode] = now.strftime("%d-%m-%Y:%H:%M:%S")
        return self.body["clock"][mode]

    def __enter__(self) -> "Run":
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.body["status"] = "failed" if kind else "passed"
        if kind:
            self.body["error"] = f"{kind.__name__}: {error}"[:2000]
        self.body["hash"] = digest(self.body)
        with open(os.path.join(self.folder, "receipt.json"), "x", encoding="utf-8") as f:
            json.dump(self.body, f, indent=2, sort_keys=True, ensure_ascii=False)
        if self.ledger:
            self.ledger.append({"run": self.id, "receipt": self.body["hash"], "status": self.body["status"]})


def load(folder: str) -> dict:
    with open(os.path.join(folder, "receipt.json"), encoding="utf-8") as f:
        return json.load(f)


def verify(folder: str) -> list[str]:
    """What of a receipt no longer holds; an empty list if all does."""
    r = load(folder)
    wrong = [] if digest({k: v for k, v in r.items() if k != "hash"}) == r["hash"] else ["the receipt itself"]
    for kind in ("inputs", "outputs"):
        for path, h in r[kind].items():
            if not os.path.exists(path):
                wrong.append(f"{path} is missing")
            elif sha256_of(path) != h:
                wrong.append(f"{path} has changed")
    return wrong


def diff(a: dict, b: dict) -> dict:
    """Fields in which two receipts differ, and what kind of difference that is."""
    fields = {}
    for kind in ("inputs", "outputs", "seals"):
        keys = sorted(set(a[kind]) | set(b[kind]))
        changed = {k: (a[kind].get(k), b[kind].get(k)) for k in keys if a[kind].get(k) != b[kind].get(k)}
        if changed:
            fields[kind] = changed
    verdict = "IDENTICAL" if not fields else "INPUTS_DIFFER" if "inputs" in fields else "RESULTS_DIFFER" if "seals" in fields else "OUTPUTS_DIFFER"
    return {"verdict": verdict, "fields": fields}


def compare_value(sealed: float, value: float, absolute: float, relative: float) -> bool:
    return abs(sealed - value) <= max(absolute, relative * max(abs(sealed), abs(value)))


def freeze(folder: str, reason: str) -> str:
    """Mark a verified run as final; its receipt and the reason are bound by a hash."""
    if verify(folder):
        raise ArtifactRefusal("a run that does not verify is not frozen")
    r = load(folder)
    note = {"run": r["run"], "receipt": r["hash"], "reason": reason, "revises": None}
    with open(os.path.join(folder, "frozen.json"), "x", encoding="utf-8") as f:
        json.dump(note | {"hash": digest(note)}, f, indent=2)
    return digest(note)


def revise(new_folder: str, old_folder: str, reason: str) -> str:
    """Freeze a run as the successor of a frozen one."""
    with open(os.path.join(old_folder, "frozen.json"), encoding="utf-8") as f:
        old = json.load(f)
    if verify(new_folder):
        raise ArtifactRefusal("a run that does not verify is not frozen")
    r = load(new_folder)
    note = {"run": r["run"], "receipt": r["hash"], "reason": reason, "revises": old["hash"]}
    with open(os.path.join(new_folder, "frozen.json"), "x", encoding="utf-8") as f:
        json.dump(note | {"hash": digest(note)}, f, indent=2)
    return digest(note)


def lineage(folders: list[str]) -> list[str]:
    """Runs from the first to the last revision."""
    notes = {}
    for folder in folders:
        with open(os.path.join(folder, "frozen.json"), encoding="utf-8") as f:
            n = json.load(f)
            notes[n["revises"]] = n
    out, at = [], None
    while at in notes:
        out.append(notes[at]["run"])
        at = notes[at]["hash"]
    return out
