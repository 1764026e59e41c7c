"""Near copies of benchmark items, by the plain similarity of their five-word shingles."""

import pytest

from strandline.llm import decontaminate

ITEM = [f"word{i}" for i in range(50)]


def found(spark, texts, items):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.contaminated(d, bench).collect()
    clean = {r.doc_id for r in decontaminate.keep_clean(d, bench).collect()}
    assert clean == set(range(len(texts))) - {r.doc_id for r in rows}
    return {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in rows}


def test_texts_shorter_than_the_item(spark):
    texts = [" ".join(ITEM[1:]), " ".join(ITEM[:-1]), " ".join(ITEM[:3] + ITEM[4:]), " ".join(ITEM[:39]), " ".join(ITEM[:3])]
    got = found(spark, texts, [" ".join(ITEM)])
    assert set(got) == {(0, 0), (1, 0), (2, 0)}  # 39 words: 35 of 46 shingles
    assert got[0, 0] == (pytest.approx(45 / 46, abs=1e-6), 0, 49)


def test_near_copies_of_repeated_and_template_items(spark):
    inner, last = [*ITEM], [*ITEM]
    inner[20] = last[-1] = "changed"
    texts = [" ".join(inner), "before it " + " ".join(inner) + " after it", " ".join(last)]
    got = found(spark, texts, [" ".join(ITEM)] * 67)
    assert set(got) == {(d, i) for d in range(3) for i in range(67)}
    assert got[0, 0][0] == pytest.approx(41 / 51, abs=1e-6)
    template = [" ".join([f"head{i}", *ITEM]) for i in range(67)]
    assert (0, 5) in found(spark, [" ".join(["head5", *last])], template)


def test_weights_do_not_depend_on_blocks(spark, monkeypatch):
    rows = [" ".join([*ITEM[:10], *(f"x{i}y{j}" for j in range(60))]) for i in range(6)]
    texts = [r.replace("word3", "changed") for r in rows] + [r.replace("y59", "changed") for r in rows]
    whole = found(spark, texts, rows + rows[:2])
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert found(spark, texts, rows + rows[:2]) == whole and whole
