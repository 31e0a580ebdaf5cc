"""Special tokens' strings in texts are encoded as the tokenizer does by default."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from cohortlake.llm import ffd
from cohortlake.llm.queries import WORDS


def test_markers_in_texts(spark):
    tok = Tokenizer.from_file(WORDS)
    texts = ["hello <|endoftext|> world", "<|startoftext|>one two<|endoftext|>", "a<|endoftext|>b, c.<|startoftext|>\nd", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ffd.pack(ffd.tokenize(df, WORDS)).collect()}
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert got[i].doc_tokens == len(ids) and np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert {3306, 49407, 1002} < set(np.frombuffer(got[0].ids, "<u4").tolist())
