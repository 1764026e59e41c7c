"""Every stage of the pipeline against its own brute force, on its own input."""

import pytest
from conftest import SF
from harness import plain
from test_llm_operators import brute_lines, brute_targets
from test_similar import brute_kept

import corpus_pipeline
from strandline.llm import decontaminate, quality
from strandline.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """[(name, input, output)] of all stages over the small table, written and read as the pipeline does."""
    out, docs, at = [], table(spark, SF, "documents"), tmp_path_factory.mktemp("stages")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(at / str(i)))
        got = spark.read.parquet(str(at / str(i)))
        out.append((name, docs, got))
        docs = got
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(spark, steps):
    columns = table(spark, SF, "documents").columns
    assert len(corpus_pipeline.STAGES) == 5
    assert all(out.columns == columns for _, _, out in steps[:-1]) and steps[-1][2].columns == [*columns, "copies", "taken"]


def test_quality_stage(spark, steps):
    _, docs, out = steps[0]
    score = {r.doc_id: r.predicted for r in quality.score_quality(docs, table(spark, SF, "labels")).collect()}
    assert set(by_id(out)) == {d for d, p in score.items() if p == 1}


def test_line_stage(spark, steps):
    _, docs, out = steps[1]
    rows = sorted((d, r.text) for d, r in by_id(docs).items())
    kept, size = brute_lines(rows), {d: t.count("\n") for d, t in rows}
    got = {d: r.text for d, r in by_id(out).items()}
    want = {d: kept[d, i] for i, (d, _) in enumerate(rows)}
    assert got == {d: t for d, t in want.items() if t or d in got} and all(size[d] == 0 or want[d] == "" for d in set(want) - set(got))


def test_near_stage(steps):
    _, docs, out = steps[2]
    rows = sorted((d, r.text) for d, r in by_id(docs).items())
    assert set(by_id(out)) == {rows[i][0] for i in brute_kept([t for _, t in rows])}


def test_decontamination_stage(spark, steps):
    _, docs, out = steps[3]
    bench = table(spark, SF, "benchmark")
    hit = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
    exact = {d for d, r in by_id(docs).items() for b in bench.collect() if b.text in (r.text or "")}
    assert exact <= hit and set(by_id(out)) == set(by_id(docs)) - hit


def test_mixing_stage(steps):
    _, docs, out = steps[4]
    rows, got = by_id(docs), by_id(out)
    size = {d: len(r.text.split()) for d, r in rows.items()}
    total = {}
    for d, r in rows.items():
        total[r.source] = total.get(r.source, 0) + size[d]
    target, taken = brute_targets(total), dict.fromkeys(total, 0)
    for d, r in got.items():
        assert r.taken == r.copies * size[d] and 1 <= r.copies <= 3 and plain(r.text) == plain(rows[d].text)
        taken[r.source] += r.taken
    largest = {s: max(size[d] for d, r in rows.items() if r.source == s) for s in total}
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + largest[s] / 2 for s in total)  # whole documents only


def test_run_is_the_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[-1][2].collect()))
