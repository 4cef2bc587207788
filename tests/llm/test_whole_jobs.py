"""Operators on inputs whose finds a cap, a stride or an excluded class would lose."""

import random
import string

import pyarrow as pa

from offerlens.llm import common
from offerlens.llm import license_scan as LS
from offerlens.llm import secrets as SE


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_every_notice_of_a_long_file_is_labelled(spark):
    mit = next(words for label, words, keys in LS.TEMPLATES if label == "mit" and len(keys) == 2)
    both = f"{mit}\n\nfiller words in between\n\nLicensed under the Apache License, Version 2.0"
    every = "\n\n".join(words for _, words, _ in LS.TEMPLATES)
    # the second notice's words are common, the first's rare
    rows = [(1, both), (2, every), *[(10 + i, "Licensed under the Apache License, Version 2.0") for i in range(30)]]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in LS.scan_licenses(docs(spark, rows)).collect()}
    assert got[1] == {"mit", "apache-2.0"}
    assert got[2] >= {label for label, _, _ in LS.TEMPLATES}


def test_glued_and_letter_only_secrets_are_found(spark):
    rnd = random.Random(5)
    key = lambda letters, n=40: "".join(rnd.choice(letters) for _ in range(n))
    base62, alpha = string.ascii_letters + string.digits, string.ascii_letters
    shapes = ["AUTH_HASH={}", "https://x.test/cb?sig={}", "s3 my-bucket/files/{}", "key_{}/part-1", "{}"]
    plain = "the quick brown fox reads some_ordinary_identifier_names and /usr/local/share-data/words-of-a-path every day"
    rows = [(i, f"{plain} {shapes[i % 5].format(key(alpha if i % 5 == 4 else base62))} and goes on") for i in range(100)]
    rows += [(1000 + i, plain) for i in range(100)]
    out = {r["doc_id"]: r for r in SE.scan_secrets(docs(spark, rows)).collect()}
    for shape in range(5):
        assert sum(out[i]["n_random"] > 0 for i in range(shape, 100, 5)) >= 17, shapes[shape]
    assert sum(out[i]["n_random"] for i in out if i >= 1000) == 0
    masked = [r["text"] for r in SE.mask_secrets(docs(spark, rows)).collect()]
    assert sum("[secret]" in t for t in masked) >= 85


def test_rows_of_one_or_no_id_keep_their_own_labels(spark):
    mit, apache = "released under the MIT license", "licensed under the Apache License, Version 2.0"
    rows = [(1, f"{mit} and so on"), (1, "nothing here"), (None, mit), (None, f"word {apache}"), (2, f"{mit} {apache}")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["labels"]) for r in LS.scan_licenses(docs(spark, rows)).collect())
    assert got == [(0, 5, "mit"), (0, 9, "apache-2.0"), (1, 2, ""), (1, 8, "mit"), (2, 13, "apache-2.0,mit")]


def test_a_word_of_many_files_counts_less_for_the_score(spark):
    # "software" stands in every file, licence or not; with room for two words it is not among the rarest
    rows = [(1, "unencumbered software released into the public domain, free, and this is it"), *[(10 + i, "plain software talk") for i in range(20)]]
    out = LS.scan_licenses(docs(spark, rows), rarest=3).where("doc_id = 1").first()
    assert out["labels"] == "" or 0 < out["score"] <= 1
    text = "this is free and unencumbered software released into the public domain"
    rows[0] = (1, text)
    assert LS.scan_licenses(docs(spark, rows)).where("doc_id = 1").first()["labels"] == "unlicense"


def test_slices_of_a_large_batch_copy_one_slice_at_a_time():
    texts = [None, "", *("é" * n for n in range(0, 40_000, 40))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    held, most, seen = pa.total_allocated_bytes(), 0, []
    for part, col in common.slices(iter([batch]), most=1 << 20):
        most = max(most, pa.total_allocated_bytes() - held)
        assert part.num_rows == len(col) and (len(col) == 1 or sum(map(len, (t.encode() for t in col.to_pylist()))) <= 1 << 20)
        seen += zip(part.column(0).to_pylist(), col.to_pylist(), strict=True)
    assert seen == [(i, t or "") for i, t in enumerate(texts)]
    assert most < 8 << 20 < batch.nbytes
