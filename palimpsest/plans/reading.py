"""Queries: datasets, extraction, chunks, segments, word pairs, keywords, threads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators import mutations as mu
from palimpsest.operators import segments as sg
from palimpsest.operators import texts as tx
from palimpsest.plans.common import MEMORIES, MESSAGES, Registry, memories, messages, r
from palimpsest.runtime import run_folder, shared_folder, table
from palimpsest.sources import tabular as tb
from palimpsest.sources.datasets import Datasets

_reg = Registry()
_M = f"WITH {MEMORIES} "
_STOP = "(" + ", ".join("'" + w + "'" for w in tx.STOP_WORDS) + ")"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{run_folder(spark)}/files-{uuid.uuid4().hex}"


@_reg.add("""SELECT 'parts' AS name, 'id' AS key, count(*) FILTER (p_partkey % 5 <> 0) AS n, count(*) FILTER (p_partkey % 5 = 0) AS refused FROM part
UNION ALL SELECT 'suppliers', 'id', count(*), 0 FROM supplier""")
def source_dataset_catalog(spark, folder):
    """Three datasets are created and filled, one is dropped; what the catalog lists, with its rows and the rows refused."""
    store = Datasets(spark, _folder(spark))
    columns = [("id", "i64", False), ("label", "text", False), ("note", "text", True)]
    for name in ("suppliers", "parts", "gone"):
        store.create("ann", name, columns, ["id"])
    as_row = lambda df, key, label: df.select(F.to_json(F.struct(F.col(key).alias("id"), label.alias("label"))).alias("row"))
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    refused = {"parts": store.insert("ann", "parts", as_row(part, "p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")))).count(), "suppliers": store.insert("ann", "suppliers", as_row(supplier, "s_suppkey", F.col("s_name"))).count()}
    store.drop("ann", "gone")
    rows = [(e["name"], e["key"].strip('[]"'), store.count("ann", e["name"]), refused[e["name"]]) for e in store.list("ann").collect()]  # a row per dataset of one user
    return spark.createDataFrame(rows, "name string, key string, n long, refused long")


@_reg.add("""SELECT json_object('id', p_partkey)::VARCHAR AS row_pk, 'memory' AS kind, 'm' || p_size AS target_id FROM part WHERE p_partkey % 3 <> 0""")
def source_row_links(spark, folder):
    store = Datasets(spark, _folder(spark))
    links = table(spark, folder, "part").select(F.lit("parts").alias("dataset"), tb.row_key(F.col("p_partkey").alias("id")).alias("row_pk"), F.lit("memory").alias("kind"), F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("target_id"), "p_partkey")
    store.link(links)
    store.link(links.where("p_partkey % 3 = 0"), remove=True)
    return store.links("parts").select("row_pk", "kind", "target_id")


@_reg.add("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def source_csv_round_trip(spark, folder):
    path = _folder(spark)
    table(spark, folder, "supplier").select("s_suppkey", "s_name").write.option("header", True).csv(path)
    return tb.read_csv(spark, path).select("s_suppkey", "s_name")


@_reg.add("SELECT r_name, string_agg('key: ' || n_nationkey || ', name: ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def source_csv_text(spark, folder):
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))  # five nations a region
    content = F.concat(F.lit("key,name\n"), F.array_join(F.transform("l", lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(',"'), x["n_name"], F.lit('"'))), "\n"))
    return sg.csv_texts(lines.select("r_name", content.alias("csv")), "r_name", "csv")


@_reg.add("SELECT doc_id, len([w for w in string_split_regex(text, '\\s+') if w <> '']) AS words, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS lines FROM documents WHERE text IS NOT NULL")
def source_plain_text(spark, folder):
    words, lines = sg.plain_counts(F.col("text"))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", words.alias("words"), lines.alias("lines"))


@_reg.add(f"WITH x AS (SELECT doc_id, list_sort(list_distinct([lower(n) for n in regexp_extract_all(text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'def load_' || doc_id || '(x):' || chr(10) || '  class Probe: pass' ELSE '' END, '{sg.DECLARATION}', 2) if length(n) > 1])) AS names FROM documents) SELECT doc_id, names FROM x WHERE len(names) > 0")
def source_code_names(spark, folder):
    """Every third document has a declaration added, since few hold any."""
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("def load_"), F.col("doc_id").cast("string"), F.lit("(x):\n  class Probe: pass"))).otherwise("")
    return table(spark, folder, "documents").select("doc_id", sg.code_names(F.concat("text", F.lit("\n"), code)).alias("names")).where("size(names) > 0")


@_reg.add(_M + "SELECT user_id, count(*) AS n, max(epoch_us(created_at)) AS last_us FROM m WHERE content IS NOT NULL GROUP BY 1")
def source_foreign(spark, folder):
    """Memories in the flat form of another store, read back."""
    m = memories(spark, folder, "content is not null")
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = m.select(F.to_json(F.struct(F.col("content").alias("memory"), "user_id", stamp.alias("created_at"), "tags")).alias("document"))
    return tb.import_foreign(rows, "flat").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.unix_micros("created_at")).alias("last_us"))


@_reg.add()
def source_html(spark, folder):
    """Titles and texts of documents wrapped in markup and read back; tested for a round trip."""
    d = table(spark, folder, "documents").where("title is not null")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>"), safe(F.col("title")), F.lit("</title><script>x()</script></head><body><p>"), F.replace(safe(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    return tb.extract_html(d.select("doc_id", page.alias("html")), "doc_id", "html")


@_reg.add()
def source_formats(spark, folder):
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"source": b["source"], "format": [tb.detect_format(None, t or "") for t in b["text"]]})

    found = table(spark, folder, "documents").select("source", "text").mapInPandas(run, "source string, format string")
    return found.groupBy("source", "format").agg(F.count("*").alias("n"))


@_reg.add()
def text_chunks_natural(spark, folder):
    """Tested for coverage, sizes and ends."""
    return sg.chunks(table(spark, folder, "documents"), "doc_id", "text")


@_reg.add()
def text_segments(spark, folder):
    return sg.segmented(table(spark, folder, "documents"), "doc_id", "text")


@_reg.add(_M + f""", s AS (SELECT id, unnest(string_split_regex(lower(content), '[.!?\\n]+')) AS s FROM m), w AS (SELECT [w for w in string_split_regex(s, '[^a-z0-9]+') if length(w) >= 3 and w not in {_STOP}] AS w FROM s),
i AS (SELECT w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1), p AS (SELECT w[i] AS first, unnest(w[i + 1:]) AS second FROM i) SELECT first, second, count(*) AS n FROM p GROUP BY ALL""")
def text_word_pairs(spark, folder):
    return sg.word_pairs(memories(spark, folder, "content is not null"), "content")


@_reg.add()
def text_yake(spark, folder):
    return sg.keywords(table(spark, folder, "documents"), "doc_id", "text").withColumn("importance", r("importance"))


@_reg.add()
def topic_threads_stemmed(spark, folder):
    m = messages(spark, folder, "msg_type = 'content' and content is not null")
    return sg.topic_threads(m.select(F.col("msg_id").alias("id"), "session_id", "ts", "content"), "session_id", ["ts"], "content")


@_reg.add()
def entities_with_salience(spark, folder):
    return sg.extracted_entities(memories(spark, folder, "content is not null"), "id", "content").withColumn("salience", r("salience"))


@_reg.add(_M + """, x AS (SELECT a.id AS new_id, b.id AS old_id, round(0.8::DOUBLE + 0.2::DOUBLE * coalesce(a.importance::DOUBLE, 0), 6) AS similarity, coalesce(a.importance::DOUBLE, 0) AS new_importance, coalesce(b.importance::DOUBLE, 0) AS old_importance, (epoch_us(a.created_at) - epoch_us(b.created_at)) / 3600000000.0::DOUBLE AS h FROM m a JOIN m b ON b.id = a.parent_id),
y AS (SELECT *, max((similarity >= 0.95)::INT) OVER (PARTITION BY new_id) = 1 AS duplicate, (similarity - 0.85::DOUBLE) / 0.15::DOUBLE AS s, h < 24 OR old_importance < new_importance AS fades FROM x WHERE similarity >= 0.85 AND new_id <> old_id)
SELECT new_id, old_id, duplicate, round(CASE WHEN duplicate THEN 0 WHEN fades THEN 0.1::DOUBLE * s ELSE 0 END, 6) AS retroactive, round(CASE WHEN duplicate THEN 0 WHEN NOT fades AND old_importance > 0.8 THEN 0.05::DOUBLE * s * (old_importance - 0.8::DOUBLE) ELSE 0 END, 6) AS proactive FROM y""")
def mutate_interference(spark, folder):
    """Each memory against its parent, as if their similarity grew with its importance."""
    m = memories(spark, folder)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    old = m.select(F.col("id").alias("parent_id"), value("importance").alias("old_importance"), F.col("created_at").alias("old_at"))
    new = m.where("parent_id is not null").select(F.col("id").alias("new_id"), "parent_id", value("importance").alias("new_importance"), "created_at")
    met = new.join(old, "parent_id").select("new_id", F.col("parent_id").alias("old_id"), F.round(0.8 + 0.2 * F.col("new_importance"), 6).alias("similarity"), "new_importance", "old_importance", ((F.unix_micros("created_at") - F.unix_micros("old_at")) / 3_600_000_000.0).alias("old_age_hours"))
    return mu.interference(met).withColumns({"retroactive": r("retroactive"), "proactive": r("proactive")})


@_reg.add()
def query_parsed(spark, folder):
    """The judged questions taken apart; the rules are tested one by one."""
    import pandas as pd

    from palimpsest.functions.querying import parsed

    def run(batches):
        for b in batches:
            rows = [(i, p["kind"], p["parts"], p["nouns"], p["labels"], p["wanted"], p["confidence"], p["expansion"], p["dates"]) for i, t in zip(b["item_id"], b["query_text"]) for p in [parsed(t or "")]]
            yield pd.DataFrame(rows, columns=["item_id", "kind", "parts", "nouns", "labels", "wanted", "confidence", "expansion", "dates"])

    items = table(spark, folder, "eval_items").select("item_id", "query_text")
    return items.mapInPandas(run, "item_id long, kind string, parts array<string>, nouns array<string>, labels array<string>, wanted array<string>, confidence double, expansion array<string>, dates array<string>")


QUERIES, ORACLE_SQL = _reg.queries, _reg.sql
