"""Texts reach the Python workers in batches of a few MB, however many rows a batch may have."""

import public_tokenizers
import pytest

from quietframe.llm import packing, quality, warc


@pytest.fixture
def largest(spark, tmp_path, monkeypatch):
    """largest(): bytes of the largest batch that any mapInArrow has got since."""
    frame = type(spark.range(0))
    real = frame.mapInArrow

    def spied(self, func, schema, *a, **b):
        place = str(tmp_path)

        def seen(batches):
            import os
            import uuid

            def passed():
                for batch in batches:
                    open(os.path.join(place, f"{batch.nbytes}-{uuid.uuid4().hex}"), "w").close()
                    yield batch

            yield from func(passed())

        return real(self, seen, schema, *a, **b)

    monkeypatch.setattr(frame, "mapInArrow", spied)
    return lambda: max(int(p.name.split("-")[0]) for p in tmp_path.iterdir())


def long_texts(spark, name):
    """300 rows of 100,000 bytes in one partition, 30 MB in all."""
    return spark.range(0, 300, 1, 1).selectExpr(f"id AS {name[0]}", f"repeat(concat('w', id, ' some words '), 100000 div length(concat('w', id, ' some words '))) AS {name[1]}")


def test_quality_batches(spark, largest):
    docs = long_texts(spark, ("doc_id", "text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert quality.resample(docs, labels, spark).count() == 300
    assert largest() < 5 << 20


def test_packing_batches(spark, largest):
    docs = long_texts(spark, ("doc_id", "text"))
    out = packing.pack(docs, spark, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert out.select("doc_id").distinct().count() == 300
    assert largest() < 5 << 20


def test_warc_batches(spark, largest):
    pages = long_texts(spark, ("page_id", "html")).selectExpr("page_id", "concat('http://a.b.com/', page_id) AS url", "html")
    out = warc.archive_and_read(pages, spark)
    assert out.filter("record_type = 'response'").count() == 300
    assert largest() < 5 << 20
