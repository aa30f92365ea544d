"""The pipeline against its stages done one document at a time."""

import math

import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from panelforge.llm import langid, pii

from .conftest import SF
from .test_operators import check_packing, naive_components, naive_print, plain_personal, plain_total, rows, whole_vocabulary  # noqa: F401


def known_by_hand(text, model, pieces):
    """Whether one language gives the words more than a chance of 1 in 256 a byte."""
    found = regex.findall(r"\p{L}+", text.lower())
    return bool(found) and max(plain_total(found, model, pieces)) > -math.log(256) * sum(1 + len(w.encode()) for w in found)


def redacted_by_hand(text, spans):
    """Spans replaced from the end; of spans that overlap the first one's kind stands for all."""
    groups = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if groups and a < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], b)
        else:
            groups.append([k, a, b])
    for k, a, b in reversed(groups):
        text = f"{text[:a]}[{pii.KINDS[k].upper()}]{text[b:]}"
    return text


def test_pipeline(spark, texts, documents, whole_vocabulary):  # noqa: F811
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = langid.train(documents, path)
    known = {i: t for i, t in texts.items() if known_by_hand(t, model, whole_vocabulary)}
    groups = naive_components({i: naive_print(t) for i, t in known.items()})
    kept = {i: t for i, t in known.items() if groups[i] == i}
    assert len(kept) < len(texts) and len(known) >= len(texts) - 3
    redactor = pii.train(documents.where(documents.doc_id.isin(list(kept))))
    clean = {i: redacted_by_hand(t, plain_personal(t, redactor)) for i, t in kept.items()}
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: hf.encode(t, add_special_tokens=False).ids + [2] for i, t in clean.items()}
    check_packing(rows(corpus_pipeline.run(spark, SF)), ids)


def test_stages_take_messy_and_empty_tables(spark, messy, nothing):
    for start in (messy, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == start.columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (start is messy)
