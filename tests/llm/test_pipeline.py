"""Each stage on the rows its predecessor kept, against plain Python."""

from pathlib import Path

import pytest
import sentencepiece

import corpus_pipeline
from tallyweave.llm import toxicity
from tallyweave.llm.common import read_table
from tallyweave.llm.queries import sentencepiece_model
from tallyweave.session import cut_lineage

from .test_decontaminate import _plain as plain_hits
from .test_lines import SPACE, _plain as plain_lines
from .test_neardup import _plain as plain_groups

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def _texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = read_table(spark, SF, "documents")
    columns = docs.columns

    out = cut_lineage(steps["toxicity"](spark, docs, SF))
    scorer = toxicity.Scorer(toxicity.train(docs, read_table(spark, SF, "labels")))
    rows = _texts(docs)
    assert _texts(out) == [r for r, s in zip(rows, scorer.score([t for _, t in rows])) if s < 0.5]

    rows, docs = _texts(out), out
    out = cut_lineage(steps["line_dedup"](spark, docs, SF))
    left = {int(i): t for i, t in plain_lines(rows, 3)}
    assert _texts(out) == [(i, left[i]) for i, t in rows if left[i] == t or left[i].strip(SPACE)]
    assert all(r.n_chars == len(r.text) for r in out.collect())

    rows, docs = _texts(out), out
    out = cut_lineage(steps["near_dedup"](spark, docs, SF))
    label = plain_groups(rows, 80)
    assert _texts(out) == [(i, t) for i, t in rows if label[i] == i]

    rows, docs = _texts(out), out
    out = cut_lineage(steps["decontamination"](spark, docs, SF))
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").collect()]
    assert _texts(out) == [r for r, p in zip(rows, plain_hits([t for _, t in rows], items, 10)) if not p[1]]
    assert out.columns == columns

    rows, docs = _texts(out), out
    library = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model())
    got = {r.doc_id: r for r in steps["sentencepiece"](spark, docs, SF).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text, add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == library.decode(ids)
