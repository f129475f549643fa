"""Quality rules, language, secrets and classifier: brute force, planted cases and held-out accuracy."""

import base64
import gzip
import re
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm import common, language_id, quality_classifier, quality_rules, secret_scan
from tallyloom.llm.common import table

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"


def test_quality_figures(messy, nothing):
    def figures(text):
        words = [w for w in re.split(f"[{SPACES}]+", text) if w]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w in windows if windows.count(w) > 1} if len(windows) < 100 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
        repeated = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)

    result = quality_rules.apply_rules(messy).collect()
    want = sorted(((r["doc_id"], *figures(r["text"] or "")) for r in messy.collect()), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in result), key=str) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in result)
    assert not any(r["kept"] and r["base_failed"] for r in result)
    assert quality_rules.apply_rules(nothing).count() == 0


def test_sketches_merge_in_any_split(spark):
    docs = quality_rules.base_figures(table(spark, SF, "documents")).withColumns({**quality_rules._figures(), "base_failed": F.lit(False)})
    keys = ["lang", "source", "figure", "bucket"]
    whole = quality_rules.sketches(docs)
    halves = quality_rules.sketches(docs.where("doc_id % 2 = 0")).union(quality_rules.sketches(docs.where("doc_id % 2 = 1")))
    assert whole.exceptAll(halves.groupBy(*keys).agg(F.sum("n").alias("n"))).count() == 0


def test_quality_rules_stay_native(spark):
    plan = quality_rules.apply_rules(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)


def test_quality_rules_on_labels(spark):
    labels = table(spark, SF, "labels")
    joined = quality_rules.apply_rules(table(spark, SF, "documents")).join(labels, "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in joined.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.1 * (n.get((0, False), 0) + 1) and n.get((1, False), 0) <= 0.01 * n[1, True]


def test_language(spark, messy, nothing):
    docs = table(spark, SF, "documents")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 60")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    profiles = language_id.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(messy, profiles).collect()}
    assert all(got[k] == ("und", 0.0) for k in (2, 3, 4, 7)) and got[6][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(messy, profiles).count() == messy.count()
    assert {r["lang_pred"] for r in language_id.identify(messy.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(nothing).count() == 0


def test_base_secrets():
    key = "AKIA" + "Z" * 12
    text = f"é PassWord = 'abcd1234' token:short api_key=\"x/y+z_w-1\" {key} AKIA123 " + "0f" * 16 + " " + "0f" * 15
    spans = secret_scan.base_spans(text)
    assert [(secret_scan.KINDS[k], text[a:b]) for a, k, b in spans] == [
        ("assign", "PassWord = 'abcd1234"),
        ("assign", 'api_key="x/y+z_w-1'),
        ("access", key),
        ("hex", "0f" * 16),
    ]


def test_nested_secrets_map_to_the_original():
    secret = "password=hunter2hunter2"
    code = base64.b64encode(secret.encode()).decode()
    nested = {
        "plain": secret,
        "url": "".join(f"%{b:02X}" for b in secret.encode()),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in secret),
        "entity": "".join(f"&#{ord(c)};" for c in secret),
        "base64": code,
        "twice": base64.b64encode(code.encode()).decode(),
        "gzip": base64.b64encode(gzip.compress(secret.encode(), mtime=0)).decode(),
        "zlib in url": quote(base64.b64encode(zlib.compress(zlib.compress(secret.encode()))).decode(), safe=""),
        "url in base64": base64.b64encode(quote(secret, safe="").replace("p", "%70").encode()).decode(),
    }
    for name, body in nested.items():
        text = f"données été {body} the end"
        found = [text[a:b] for a, k, b in secret_scan.all_spans(text) if k == 0]
        assert found and found[-1].startswith(body[:5]) and body.rstrip("=").startswith(found[-1].rstrip("=")[: len(body) - 9]), name
        assert "hunter2" not in secret_scan.masked(text) and secret_scan.masked(text).startswith("données été [SECRET]"), name
    for harmless in ("100%25 sure", "%25" * 50, "the " * 2000, "Q" * 4000, "\\u0025\\u0032\\u0035"):
        assert secret_scan.all_spans(harmless) == []


def test_secret_rows(messy, nothing):
    rows = {r["doc_id"]: r for r in secret_scan.scan(messy).collect()}
    assert rows[2]["spans"] == "" and rows[8]["n_hex"] == 1 and rows[8]["spans"] == "hex:0:5000"
    masked = secret_scan.mask_secrets(messy)
    assert masked.columns == messy.columns and masked.where("doc_id = 2 and text is null").count() == 1
    assert masked.where("doc_id = 8").first()["text"] == "[SECRET] b" and masked.where("doc_id = 8").first()["n_chars"] == 10
    assert secret_scan.scan(nothing).count() == 0


def test_classifier(spark, messy, nothing):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95
    model = quality_classifier.learn(docs, labels)
    scores = [r["score"] for r in quality_classifier.score(messy, model).collect()]
    assert len(scores) == messy.count() and all(0 <= s <= 1 for s in scores)
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert all(0 <= r["score"] <= 1 for r in quality_classifier.classify(messy, some).collect())
    assert quality_classifier.classify(nothing, labels).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    bag = np.repeat(np.arange(40), 3)
    x = rng.normal(size=(120, quality_classifier.FEATURES))
    label = rng.integers(0, 2, 40).astype(float)
    x[np.arange(0, 120, 3), 0] += 6 * label  # one passage of a bag tells its label
    model = quality_classifier.train(x, bag, label)
    assert ((model.score(x, bag) > 0.5) == (label == 1)).mean() > 0.95
    assert np.allclose(np.add.reduceat(model.forward(x, bag)["a"], np.arange(0, 120, 3)), 1)


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    common.ship(spark)
    long = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    seen = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in seen) == 600 and max(r["size"] for r in seen) < 2 * common.PIECE_BYTES
