"""What the first two stages of the pipeline let through."""

import random
import string

from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_language_stage_refuses_what_was_not_learned(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").join(table(spark, SF, "labels").where("quality = 1"), "doc_id", "left_semi")
    rnd = random.Random(1)

    def noise(letters, spaced=True):
        return "".join(rnd.choice(letters) + (" " if spaced and rnd.random() < 0.2 else "") for _ in range(500))

    han, cyrillic = "".join(map(chr, range(0x4E00, 0x9000))), "".join(map(chr, range(0x430, 0x450)))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. " * 4
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 4
    base64 = string.ascii_letters + string.digits + "+/"
    foreign = [finnish, russian] + [noise(a, s) for a, s in ((string.ascii_lowercase, True), (base64, False), (han, False), (cyrillic, True)) for _ in range(20)]
    rows = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs.unionByName(rows), SF)
    n = kept.agg(F.count_if(F.col("doc_id") < 0), F.count_if((F.col("doc_id") >= 0) & (F.length("text") > 40))).first()
    assert n[0] == 0 and n[1] == docs.where("length(text) > 40").count()


def test_quality_stage_keeps_all_without_two_classes(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(50)
    labels = table(spark, SF, "labels")
    for i, some in enumerate((labels.limit(0), labels.where("quality = 0"), labels.where("quality = 1"))):
        some.write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert corpus_pipeline.quality(spark, docs, f"{tmp_path}/{i}").count() == docs.count()
