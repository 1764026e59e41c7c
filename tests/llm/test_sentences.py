"""Repeated passages of one or two long sentences, through op5's query."""

import re

import pytest

from strandline.llm import sentences
from strandline.llm.registry import queries


def test_query_removes_passages_of_few_sentences(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(55))
    two = " ".join(f"left{i}" for i in range(9)) + ", " + " ".join(f"right{i}" for i in range(9)) + "."
    tail = " ".join(f"head{i}" for i in range(12)) + ". And so. It was."
    texts = [long, long, f"Own words before. {long}. Own words after.", two, two, "Only eleven words " + "x " * 8 + ".", "Only eleven words " + "x " * 8 + ".", tail, tail + " Then other things."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in queries()["op5_sentence_span_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (3, 1), 3: (2, 0), 4: (2, 2), 5: (1, 0), 6: (1, 0), 7: (3, 0), 8: (4, 3)}


def brute(rows, fewest):
    """Kept texts of distinct (doc_id, text) rows in their order, by all spans of the rule."""
    seen, out = {}, {}
    for key, text in rows:
        b = text.encode()
        s = [(m.start(), m.end()) for m in re.finditer(rb"[^.!?,;:\n\s\0](?:[^.!?,;:\n]*[^.!?,;:\n\s\0])?", b)]
        gone = set()
        for least in {sentences.RUN, fewest}:
            for k in range(len(s)):
                for e in range(k + least - 1, len(s)):
                    span = b[s[k][0] : s[e][1]]
                    inside = 1 if s[k][0] and b[s[k][0] - 1 : s[k][0]].strip() else 0
                    if len(span.split()) - inside >= sentences.WORDS:
                        if seen.setdefault(span, (key, k)) != (key, k):
                            gone |= set(range(k, e + 1))
                        break
        out[key] = (len(s), len(gone))
    return out


@pytest.mark.parametrize("fewest", [1, 3])
def test_rows_without_id_or_with_one_id_are_documents_of_their_own(spark, fewest):
    shared = "A passage of many words stands here, it repeats across documents, and it has to go, all of it."
    own = [f"Unique text number {i} says things, that no other text says at all, not one of them, ever {i}." for i in range(6)]
    texts = [(1, shared), (None, shared), (None, own[0]), (None, own[1]), (None, own[1]), (7, own[2]), (7, own[3]), (7, shared + " " + own[4]), ((1 << 63) - 1, own[5]), (None, None), (3, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    last = (1 << 63) - 1
    keyed = d.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(doc_id, coalesce(text, '')) AS row").distinct().collect()
    rows = sorted(((last if r.doc_id is None else r.doc_id, r.row), r.text) for r in keyed)
    want = brute(rows, fewest)
    by_text = {(last if r.doc_id is None else r.doc_id, r.text): (last if r.doc_id is None else r.doc_id, r.row) for r in keyed}
    got = sentences.removed_sentences(d, fewest).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in texts)
    assert sorted((r.n_sentences, r.n_removed) for r in got) == sorted(want[by_text[last if i is None else i, t or ""]] for i, t in texts)
    assert {r.kept for r in got} >= set(own[:4]) | {own[5]}
