"""The ids of the store are the library's for special strings in any case and for decomposed capitals."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from palisade.llm import token_store  # noqa: E402

WORDS = P.path("word_bpe_49k.json")
TEXTS = ["see <|ENDOFTEXT|> here", "<|EndOfText|>", "A<|StartOfText|>B <|endoftext|>", "H̱", "T̈ W̊ J̌", "Some Words H̱ And <|ENDOFTEXT|>.", "İ Á é", "A中 ÉTÉ ABC."]


def test_ids_are_the_librarys():
    t = tokenizers.Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        encoder = token_store.Encoder(f.read(), 2)
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice([*"AbHtWj .,\n<|", "̱", "̈", "̊", "̌", "É", "Σ", "'s", "!!", "_", "9", "<|ENDOFTEXT|>", "<|endoftext|>"]) for _ in range(rng.randrange(40))) for _ in range(2000)]
    wrong = [x for x, got in zip(texts, encoder.encode([x.encode() for x in texts]), strict=True) if np.frombuffer(got, encoder.dtype).tolist() != [*t.encode(x, add_special_tokens=False).ids, 2]]
    assert not wrong, (len(wrong), wrong[:5])


def test_lost_and_replaced_recipes_are_found(spark):
    import shutil

    df = spark.createDataFrame([(i, f"some words {i} to keep") for i in range(60)], "doc_id long, text string")
    with open(WORDS, encoding="utf-8") as f:
        store = token_store.write_store(spark, df, f.read(), 2, rows_in_file=20)
    assert token_store.read_checksums(spark, store).count() == 60
    path = f"{store.path}/recipes".removeprefix("file:")
    rows = store.recipes(spark).orderBy("start").toPandas()
    # a recipe that is replaced by another one whole, which is right in itself
    for c in ("names", "lengths", "root", "n_tokens"):
        rows.at[0, c] = rows.at[1, c]
    schema = store.recipes(spark).schema
    shutil.copytree(path, f"{path}-kept")
    spark.createDataFrame(rows, schema).write.mode("overwrite").partitionBy("part").parquet(f"{store.path}/recipes")
    with pytest.raises(Exception, match="does not verify"):
        token_store.read_checksums(spark, store).collect()
    shutil.rmtree(path)
    shutil.copytree(f"{path}-kept", path)
    assert token_store.read_checksums(spark, store).count() == 60
    shutil.rmtree(f"{path}/part=1")
    with pytest.raises(Exception, match="does not verify"):
        token_store.read_checksums(spark, store).collect()
