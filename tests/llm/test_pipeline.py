"""The pipeline: every stage's decisions take effect on whole texts, and the columns stay."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from rivulet.llm import decontaminate
from rivulet.session import settle

from .helpers import SF, awkward, empty
from .test_joins import naive_groups
from .test_texts import naive_verdicts


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(settle(stage(spark, steps[-1], SF)))
    for s in steps[1:-1]:
        assert s.columns == docs.columns
    tables = [{r.doc_id: r for r in s.collect()} for s in steps]
    verdicts = naive_verdicts([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    assert set(tables[1]) == {i for i, (_, kept, _) in verdicts.items() if kept}
    order = sorted(tables[1])
    group, _ = naive_groups([tables[1][i].text for i in order])
    assert sorted(tables[2]) == sorted({order[g] for g in group})
    leaks = {r.doc_id for r in decontaminate.leaks(steps[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(tables[3]) == set(tables[2]) - leaks and leaks
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(tables[5]) == set(tables[4]) == set(tables[3])
    for i, r in tables[5].items():
        assert r.exact and r.ids == library.encode(tables[4][i].text, add_special_tokens=False).ids and r.n_chars == len(r.text)
        assert "@mail" not in r.text
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {i: r.n_tokens for i, r in tables[5].items()}


def test_stages_of_awkward_rows(spark):
    for rows in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert set(rows.columns) <= set(out.columns), name
            assert out.count() <= rows.count()
