"""The pipeline's stages, each held against brute force on what the stage before kept."""

import corpus_pipeline
import test_text_operators as brute

import cases
from stratalog.llm import decontaminate, neardup, packing, secret_scan, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    assert [f for _, f in corpus_pipeline.STAGES] == [toxicity.keep_clean, neardup.keep_one, decontaminate.keep_clean, secret_scan.redact, packing.pack_stage]
    docs = cases.real(spark, SF)
    tables = [("documents", docs), *corpus_pipeline.stages(spark, SF)]
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in tables[:-1]}
    for name, df in tables[:-1]:
        assert df.columns == docs.columns

    model = toxicity.train(docs, cases.real(spark, SF, "labels"))
    assert set(rows["toxicity"]) == {i for i, r in rows["documents"].items() if model.score(r.text) < 0.5}
    labels = {r.doc_id: r.toxic for r in cases.real(spark, SF, "labels").collect()}
    gone = set(rows["documents"]) - set(rows["toxicity"])
    assert sum(labels.get(i, 1) for i in gone) >= 0.95 * len(gone) and gone

    before = [(i, r.text) for i, r in rows["toxicity"].items()]
    assert set(rows["near_duplicates"]) == {i for i, _, component in brute.groups(before, 5) if i == component}

    before = [(i, r.text) for i, r in rows["near_duplicates"].items()]
    items = [(r.item_id, r.text) for r in cases.real(spark, SF, "benchmark").collect()]
    long = {i for i, t in before if len(t) > 20_000}
    clean = {x[0] for x in brute.leaks([(i, t) for i, t in before if i not in long], items) if not x[5]}
    assert set(rows["decontamination"]) - long == clean

    forest = secret_scan.trained()
    for i, r in rows["decontamination"].items():
        text = r.text
        for f in reversed(secret_scan.found(text, r.source, forest)):
            text = text[: f["start"]] + "[SECRET]" + text[f["end"] :]
        assert rows["secrets"][i].text == text and rows["secrets"][i].n_chars == len(text)

    pieces = tables[-1][1].collect()
    assert brute.check_packing(pieces, [(i, r.text) for i, r in rows["secrets"].items()]) < 0.02


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
