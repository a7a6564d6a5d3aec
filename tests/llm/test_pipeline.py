"""The pipeline as a whole, on the small table with odd rows."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import pytest
from ledgerline.llm import langid
from ledgerline.llm.tokens import tokenizer_path

from . import brute

BYTES = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The tables before and after each stage, each written and read again."""
    path = tmp_path_factory.mktemp("stages")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [df]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{path}/{number}")
        tables.append(spark.read.parquet(f"{path}/{number}"))
    return tables


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert all(t.columns == stages[0].columns for t in stages[1:-1])


def test_language_stage_drops_what_is_undecided_only(spark, stages):
    model = langid.train(stages[0].filter(~langid.held_out()))
    told = langid.classify(stages[0], model).collect()
    want = brute.grouped((r.doc_id, r.text) for r in told if r.lang_pred != "und" and r.margin >= corpus_pipeline.MARGIN)
    got = brute.grouped((r.doc_id, r.text) for r in stages[1].collect())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert 0.9 * stages[0].count() < sum(map(len, got.values())) < stages[0].count()


def test_near_duplicates_leave_one_of_each_group(stages):
    before, after = stages[1].collect(), stages[2].collect()
    _, root = brute.jaccard_groups([r.text for r in before], 5, 80)
    left = brute.grouped((root[k], (r.doc_id, r.text)) for k, r in enumerate(before))
    kept = {(r.doc_id, r.text) for r in after}
    assert len(after) == len(left) and all(sum(m in kept for m in set(members)) == 1 for members in left.values())


def test_repeats_stage_matches_brute_force(stages):
    order = lambda r: (r.doc_id is not None, r.doc_id or 0)
    before = sorted(stages[2].collect(), key=order)
    ties = {k for k, v in brute.grouped((r.doc_id, r) for r in before).items() if len(v) > 1}
    assert not ties - {None, 900_016}
    got = brute.grouped((r.doc_id, r.text) for r in stages[3].collect())
    for r, rest in zip(before, brute.kept_bytes([r.text for r in before])):
        if r.doc_id not in ties:
            want = [rest.decode("utf-8", "ignore")] if rest or not r.text else []
            assert [t or "" for t in got[r.doc_id]] == want


def test_mix_takes_whole_texts_or_their_first_words(stages):
    before = defaultdict(list)
    for r in stages[3].collect():
        before[r.doc_id].append(r.text or "")
    rows = stages[4].collect()
    assert rows and all(any(t.startswith(r.text or "") for t in before[r.doc_id]) for r in rows)
    sizes = defaultdict(int)
    for r in stages[3].collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += len(brute.WORD.findall(r.text or ""))
    assert all(abs(taken[s] - t) <= 32 for s, t in brute.targets(sizes).items())


def test_run_packs_all_tokens_of_the_mix(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).collect()
    texts = stages[4].collect()
    ids = brute.tokens(BYTES, [r.text for r in texts], 0)
    want, tokens = brute.grouped((r.doc_id, len(x)) for r, x in zip(texts, ids)), defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.length
    assert dict(tokens) == {k: sum(v) for k, v in want.items()}


def test_no_documents_give_no_sequences(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
