import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
#: Columns that the operators also use as names of their own.
CLASH = ("kept", "node", "tid", "size", "word", "key", "ids", "component_id", "lang_pred", "n_words", "_kept", "host")


def edge_documents() -> list[tuple]:
    rng = random.Random(5)
    syllables = ["ta", "ro", "mi", "ven", "los", "ka", "der", "un", "pes", "qui"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300), prose(60)
    near = base.split(" ")
    near[7], near[150] = "changed", "other"
    docs = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "Word", "en", "a"), (5, "two words", "de", None),
        (6, base, "en", "a"), (7, base, "en", "a"), (7, base, "en", "a"), (8, " ".join(near), "en", "a"),
        (9, prose(120) + "\n" + passage + "\n" + prose(90), "en", "b"), (10, passage + " " + prose(150), None, "b"),
        (None, prose(70), "es", "b"), (None, None, None, None), (11, prose(40_000), "en", "a"),
        (12, "é日本語 naïve \u2581 ﷽ 😀 <s> <|endoftext|> \u00a0\u3000x", "fr", "a"), (13, "a" * 3000, "en", "a"),
        (14, "12345 67890 ### $$$", "en", "a"), (15, "one two three one two three one two three " * 30, "en", "a"),
    ]
    docs += [(100 + i, prose(80), "en", "c") for i in range(20)]
    return docs


def write_documents(folder, rows, extra=True):
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    table = pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in cols[1]], pa.int64())})
    for name in CLASH if extra else ():
        table = table.append_column(name, pa.array(["x"] * len(rows), pa.string()))
    pq.write_table(table, f"{folder}/documents.parquet")
    return str(folder)


def write_pages(folder, rows):
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    table = pa.table({"page_id": pa.array(cols[0], pa.int64()), "url": pa.array(cols[1], pa.string()), "html": pa.array(cols[2], pa.string()), "host": pa.array(["x"] * len(rows), pa.string()), "rule": pa.array(["x"] * len(rows), pa.string())})
    pq.write_table(table, f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    """Folder with documents of every odd kind, and the rows."""
    folder = tmp_path_factory.mktemp("edge")
    rows = edge_documents()
    write_documents(folder, rows)
    return str(folder), [(r[0], r[1], r[2]) for r in rows]


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    write_documents(folder, [])
    write_pages(folder, [])
    return str(folder)


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest driver tables, and its documents."""
    folder = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    return folder, [(r["doc_id"], r["text"], r["lang"]) for r in rows]
