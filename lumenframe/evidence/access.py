"""What a run is given and what it opens: parameters, answers, files by reader family, and traces of calls."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from functools import wraps

from ..errors import ArrayRefusal, DataRefusal, RandomRefusal
from ..operators.random import Stream, jump
from .receipts import canonical, digest

MAX_FILES, MAX_CALLS = 32, 64
MAX_ARGUMENTS, MAX_ANSWERS, MAX_TEXT = 64, 64, 64 << 10


class Access:
    """Files of a run: each belongs to the reader family that opened it first; files and calls are limited."""

    def __init__(self, files: int = MAX_FILES, calls: int = MAX_CALLS):
        self.files, self.calls, self.made = files, calls, 0
        self.family: dict[str, str] = {}

    def open(self, path: str, family: str) -> str:
        real = os.path.realpath(path)
        if self.family.get(real, family) != family:
            raise DataRefusal(f"{path} is already read as {self.family[real]}")
        if real not in self.family and len(self.family) >= self.files:
            raise DataRefusal(f"more than {self.files} files")
        if self.made >= self.calls:
            raise DataRefusal(f"more than {self.calls} reads")
        self.made += 1
        self.family[real] = family
        return path

    def evidence(self) -> dict:
        return {"calls": self.made, "files": dict(sorted(self.family.items()))}


class Parameters:
    """Arguments and answers that a run is given; without answers it cannot ask."""

    def __init__(self, arguments: list[str] = (), answers: list[str] | None = None):
        if len(arguments) > MAX_ARGUMENTS or any(len(a.encode()) > MAX_TEXT for a in arguments):
            raise ArrayRefusal("too many or too long arguments")
        self.arguments, self.answers = list(arguments), None if answers is None else list(answers)
        self.used = False
        self.asked: list[dict] = []

    def argc(self) -> int:
        self.used = True
        return len(self.arguments)

    def argv(self, i: int) -> str:
        self.used = True
        if not 0 <= i < len(self.arguments):
            raise ArrayRefusal(f"argument {i} of {len(self.arguments)}")
        return self.arguments[i]

    def input(self, prompt: str = "") -> str:
        if self.answers is None:
            raise ArrayRefusal("this run is given no answers")
        if len(prompt.encode()) > MAX_TEXT or len(self.asked) >= MAX_ANSWERS:
            raise ArrayRefusal("the prompt is too long, or there are too many")
        if len(self.asked) >= len(self.answers):
            raise ArrayRefusal("the answers have come to their end")
        answer = self.answers[len(self.asked)]
        self.asked.append({"prompt": prompt, "answer": answer})
        return answer

    def evidence(self) -> dict:
        return {"arguments": self.arguments if self.used else None, "answers": self.asked}


class Trace:
    """Counts and digests of calls by function name: arguments and results in the order of the calls."""

    def __init__(self):
        self.calls: dict[str, dict] = {}

    def record(self, name: str, arguments: list, result) -> None:
        entry = self.calls.setdefault(name, {"calls": 0, "arguments": hashlib.sha256(), "results": hashlib.sha256()})
        entry["calls"] += 1
        for part, value in (("arguments", list(arguments)), ("results", result)):
            raw = canonical(value)
            entry[part].update(len(raw).to_bytes(8, "big") + raw)

    def traced(self, f: Callable) -> Callable:
        @wraps(f)
        def call(*args):
            result = f(*args)
            self.record(f.__name__, args, result)
            return result

        return call

    def evidence(self) -> dict:
        return {n: {"calls": e["calls"], "arguments": e["arguments"].hexdigest(), "results": e["results"].hexdigest()} for n, e in sorted(self.calls.items())}


def stream_evidence(seed: int, number: int, stream: Stream, words: int) -> dict:
    """How far a stream has come: its seed, the words drawn and the state they lead to."""
    body = {"seed": str(seed), "stream": str(number), "words": words, "state": f"{stream.state:016x}"}
    if not replays(body):
        raise RandomRefusal("the stream does not stand where so many words lead")
    return body | {"digest": digest(body)}


def replays(body: dict) -> bool:
    """Whether the recorded state is the one that the recorded words lead to."""
    start = Stream(int(body["seed"]), int(body["stream"]))
    return jump(start.state, start.increment, body["words"]) == int(body["state"], 16)
