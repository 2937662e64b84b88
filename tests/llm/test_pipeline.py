import corpus_pipeline as pipeline
from lumenframe.llm import common, packing

from . import brute
from .test_operators import QUERIES


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]


def stage(spark, docs, name, folder):
    return common.saved(dict(pipeline.STAGES)[name](spark, docs, folder), "stage")


def test_stages_against_brute_force(spark, small):
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op7_quality_rules"](spark, folder).collect()}
    good = stage(spark, docs, names[0], folder)
    assert good.columns == columns and {r[0] for r in rows_of(good)} == {d for d, k in verdict.items() if k}

    gone = {}
    for d, i in brute.line_components([(d, t) for d, t, _ in rows_of(good)]):
        gone.setdefault(d, set()).add(i)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t, _ in rows_of(good)}
    lines = stage(spark, good, names[1], folder)
    assert lines.columns == columns and {d: t for d, t, _ in rows_of(lines)} == {d: t for d, t in want.items() if brute.WORD.search(t)}

    sets = {d: brute.shingle_set(t, 5) for d, t, _ in rows_of(lines)}
    of = brute.components(sets, brute.similar(sets, 80, 100))
    near = stage(spark, lines, names[2], folder)
    assert near.columns == columns and {r[0] for r in rows_of(near)} == {d for d, c in of.items() if d == c}

    before = rows_of(near)
    counts = brute.substring_dedup([t for _, t, _ in before])
    cut = stage(spark, near, names[3], folder)
    after = {d: t for d, t, _ in rows_of(cut)}
    assert cut.columns == columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    for (d, t, _), (n, removed, _, _) in zip(before, counts, strict=True):
        left = len(after[d].encode()) if d in after else 0
        assert n - removed - 6 <= left <= n - removed or not after.get(d)

    packed = pipeline.STAGES[-1][1](spark, cut, folder).collect()
    assert {r["doc_id"] for r in packed} == set(after) and all(r["offset"] + r["length"] <= packing.WIDTH for r in packed)


def test_odd_rows(spark, edge):
    folder, _ = edge
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in pipeline.STAGES[:-1]:
        out = common.saved(f(spark, docs, folder), "stage")
        assert out.columns == docs.columns, name
        kept = [r["doc_id"] for r in out.collect()]
        assert all(kept.count(100 + i) == 1 for i in range(20)), name
        if name == "MinHash near-dedup":
            assert sum(kept.count(d) for d in (6, 7, 8)) == 1
    assert pipeline.run(spark, folder).count() > 0


def test_empty_table(spark, empty):
    assert pipeline.run(spark, empty).count() == 0
