"""The stages beside plain Python over the same rows, and one after the other."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from feedloom.llm.common import prepare, stored
from tests.llm.samples import ODD_TEXTS, documents, prose
from tests.llm.test_decontaminate import QUESTION
from tests.llm.test_line_dedup import plain_passages
from tests.llm.test_minhash import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """The rows after each stage but the last, by name, and what the last returns."""
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
        out[name] = docs
    return {k: v.collect() for k, v in out.items()} | {"run": corpus_pipeline.run(spark, SF).collect()}


def test_stages_follow_the_plain_versions(staged):
    after = {k: {r.doc_id: r.text for r in v} for k, v in staged.items() if k != "run"}
    assert set(after["documents"]) - set(after["language"]) == set()  # all have letters and a main language
    assert after["lines"] == plain_passages(sorted(after["language"].items()))
    groups = plain_components(list(after["lines"].items()), 5, 80)
    assert set(after["near_duplicates"]) == {i for i, root in groups.items() if i == root}
    passages = [r for r in _benchmark()]
    hit = {i for i, t in after["near_duplicates"].items() if any(p in t for p in passages)}
    assert set(after["near_duplicates"]) - set(after["benchmark"]) >= hit
    assert len(after["benchmark"]) >= len(after["near_duplicates"]) - len(hit) - 3


def _benchmark():
    import pyarrow.parquet as pq
    return pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()


def test_result_is_the_kept_texts(staged):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in staged["benchmark"]}
    ids = {}
    for r in sorted(staged["run"], key=lambda r: r.start):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert ids == {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
                   for i, t in texts.items()}


def test_planted_cases(spark, tmp_path):
    copy, passage = prose(1, 300), prose(2, 400).replace(".", ".\n")
    texts = ODD_TEXTS + [(100, copy), (101, copy), (102, copy.replace("w1 ", "x1 ", 2)), (103, prose(3, 100) + " " + QUESTION),
                         (104, prose(4, 100) + ".\n" + passage), (105, prose(5, 100) + ".\n" + passage),
                         (106, "12 34 %%%"), (107, prose(6, 200))]
    documents(spark, texts, ("class_id", "bucket")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert {100, 104, 105, 107} <= kept and not {1, 2, 3, 101, 102, 103, 106} & kept
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    assert tokens[105] < tokens[104] / 2  # the shared passage is cut out of the later one


def test_no_fragment_of_a_copy_is_packed(spark, tmp_path):
    def lines(n):
        return [prose(3000 + 8 * n + k, 12, 4000) for k in range(8)]

    originals = [(n, "\n".join(lines(n))) for n in range(30)]
    copies = [(100 + n, text) for n, text in originals] + [(200 + n, text) for n, text in originals]
    # one line of eight is new: only that line is left of the copy
    near = [(300 + n, "\n".join([*lines(n)[:3], prose(9000 + n, 12, 4000), *lines(n)[4:]])) for n in range(10)]
    documents(spark, originals + copies + near).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    assert set(tokens) == set(range(30)) | {300 + n for n in range(10)}
    for n in range(30):
        assert tokens[n] == len(whole.encode(originals[n][1], add_special_tokens=False).ids) + 1
    for n in range(10):
        left = prose(9000 + n, 12, 4000)
        assert tokens[300 + n] == len(whole.encode(left, add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, name, stage):
    out = stage(prepare(spark), documents(spark, []), SF)
    assert out.collect() == []


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
