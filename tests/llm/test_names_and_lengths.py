"""Clashing column names whatever their case, and words of any length."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauseworks.llm import byte_bpe, impact, line_templates, merkle, quality, resample

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CLASHES = {"N_Tokens": 1, "Ids_SHA256": "x", "__at": 2, "__doc": 3, "__positions": 4, "Score": 5, "DOC_OF": 6, "text_hash": 7, "Positions": 8, "N_Lines": 9, "Weight": 12, "RANK": 13, "GID": 14}


@pytest.fixture(scope="module")
def rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k.replace('`', '``')}` {'string' if isinstance(v, str) else 'int'}" for k, v in CLASHES.items())
    line = "one two three four five six seven"
    return spark.createDataFrame([(i, line + "\n" + " ".join("abcd"[i] + w for w in line.split()), "en", "s", 9, *CLASHES.values()) for i in range(4)], schema)


def test_clashing_names_are_replaced_or_kept(spark, rows, tmp_path):
    encoded = byte_bpe.encode_texts(rows, RANKS, PATTERN)
    encoded.write.parquet(f"file://{tmp_path}/encoded")
    assert "N_Tokens" not in encoded.columns and encoded.columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"]
    lines = line_templates.dedup_lines(rows)
    lines.write.parquet(f"file://{tmp_path}/lines")
    assert "N_Lines" not in lines.columns and set(CLASHES) - {"N_Lines"} <= set(lines.columns)
    assert {r["doc_id"]: (r["n_dropped"], r["__at"], r["__positions"]) for r in lines.collect()} == {0: (0, 2, 4), 1: (1, 2, 4), 2: (1, 2, 4), 3: (1, 2, 4)}
    model = quality.fit(rows, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"))
    scored = quality.score(rows, model)
    scored.write.parquet(f"file://{tmp_path}/scored")
    assert "Score" not in scored.columns and scored.count() == 4
    decoded = byte_bpe.decode_ids(rows.withColumn("ids", F.array(F.lit(64))).withColumn("Decoded", F.lit(1)), RANKS)
    assert decoded.columns[-1] == "decoded" and "Decoded" not in decoded.columns
    assert merkle.proofs(merkle.manifest(rows, "doc_id", merkle.COLUMNS, "lang"), "doc_id").where("verified").count() == 4
    assert resample.resample(rows, rows.select("text")).count() == 4
    assert impact.top_k(rows.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), "Score", "RANK")).count() == 3


def test_pipeline_stages_take_clashing_names(spark, rows, sf):
    import corpus_pipeline

    done = corpus_pipeline.byte_level_bpe(spark, corpus_pipeline.line_dedup(spark, rows, sf), sf)
    assert done.count() == 4 and "__at" in done.columns


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(RANKS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(codec, text):
    return codec.contract([text.encode()])[1].tolist()


@pytest.mark.parametrize("window", [100, 1000])
def test_windows_give_the_ids_of_the_whole(codec, library, monkeypatch, window):
    monkeypatch.setattr(byte_bpe, "WINDOW", window)
    rng = random.Random(window)
    texts = ["a" * 5000, "ab" * 3000, "abc" * 1000 + "a" * 777, "".join(rng.choice("ab") for _ in range(4000)), "".join(rng.choice("etaoin") for _ in range(4000)), "é" * 2000, "".join(rng.choice("aaaaaaab") for _ in range(6000))]
    for text in [t[: 12 * window] for t in texts]:
        assert np.concatenate([codec.windows(x) for x in [text.encode()]]).tolist() == library.encode(text, add_special_tokens=False).ids
        assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [2_000_000])
def test_a_word_of_millions_of_letters(codec, library, n):
    text = "a" * n
    assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids
