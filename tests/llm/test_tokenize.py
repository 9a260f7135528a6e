import os
import random

import pytest

from docweave.llm.tokenize import cuts, encode_corpus

FILE = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="needs the tokenizer file")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_cuts_depend_on_content_alone():
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ,.") for _ in range(3000))
    a, b = "x" * 100 + shared, "quite another beginning " * 9 + shared
    ends = lambda t: {e - (len(t) - len(shared)) for e in cuts(t)}
    assert len(ends(a) & ends(b)) > 0.7 * len(ends(a))
    assert cuts("") == [] and cuts("abc") == [3]


def test_equals_whole_encoding(spark):
    rng = random.Random(5)
    parts = ["the ", "model", "'", "ll", "'ve", " \t\n ", "  ", "\n\n", "été ", "日本語", "👩‍🔬", "ＡＢ１２", "<|endoftext|>", "12345", "...", "á", " don't", "​", "=====", "x" * 70, " " * 90]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    texts += [None, "", " ", texts[0], "word " * 40_000, "x" * 20_000, "'" * 500 + "ll" * 300]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, "no id", 1), (3, "other text", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = sorted((str(r.doc_id), list(r.ids)) for r in encode_corpus(df, FILE).collect())
    want = sorted((str(i), ids) for (i, _, _), ids in zip(rows, whole([t for _, t, _ in rows])))
    assert out == want
    assert encode_corpus(df.limit(0), FILE).count() == 0
