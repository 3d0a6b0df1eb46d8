"""Queries of the training view: usable rows, names and constructs, matrices, placements, similar pairs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.operators import canonical, components, corpus, evaluation, metrics, ordering, records, reports, similar, vectors
from pairbench.plans.catalog import AP, BOTH, DNA, RUNS, VERDICTS, M, sequences
from pairbench.plans.study import SCAN, _scan
from pairbench.sources import formats
from pairbench.sources.tables import measurements, table

PAD, TILE, WINDOW = 5, 100, 9


def _m(f):
    return lambda s, d: f(measurements(s, d))


def _usable(keep_dead: bool):
    def run(m: DataFrame) -> DataFrame:
        rows = corpus.usable(m, records.verdicts(m), ["entity", "source"], keep_dead)
        return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("n_entities"))

    return _m(run)


def _usable_sql(verdicts: str) -> str:
    return f"""WITH {VERDICTS}, x AS (SELECT entity, source FROM v WHERE verdict IN ({verdicts}))
      SELECT m.source, count(*) AS n, count(DISTINCT m.entity) AS n_entities
      FROM m ANTI JOIN x ON m.entity = x.entity AND m.source = x.source GROUP BY m.source"""


def _names(s: SparkSession, d: str) -> DataFrame:
    """Record names by (brand, type) from parts that have several, some empty, with the brand as fallback."""
    p = table(s, d, "part")
    names = p.where("p_size > 40").select("p_brand", "p_type", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_name")).alias("name"))
    own = p.select("p_partkey", "p_brand", F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("p_type"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("spare"))
    return corpus.with_names(own, names, ["p_brand", "p_type"], "name", "spare").select("p_partkey", "name")


def _made(s: SparkSession, d: str) -> DataFrame:
    """Supplies as experiments, parts as plasmids, names as inserts that are made for one type (the tf)."""
    p = table(s, d, "part")
    runs = table(s, d, "lineitem").select(F.col("l_partkey").alias("plasmid"), "l_linenumber").join(p.select(F.col("p_partkey").alias("plasmid"), "p_type"), "plasmid")
    runs = runs.select("plasmid", F.when(F.col("l_linenumber") % 3 == 0, "NONE").otherwise(F.col("p_type")).alias("tf"))
    plasmids = p.where("p_size % 5 <> 0").select(F.col("p_partkey").alias("plasmid"), F.col("p_name").alias("insert"))
    inserts = p.where("p_size > 10").select(F.col("p_name").alias("insert"), F.col("p_type").alias("tf"), F.concat(F.lit(" "), F.regexp_replace("p_name", "[^a-z]", "")).alias("seq")).distinct()
    return corpus.constructs(runs, plasmids, inserts, "plasmid", "insert", "tf", "seq")


MADE = """r AS (SELECT DISTINCT l_partkey AS plasmid, CASE WHEN l_linenumber % 3 = 0 THEN 'NONE' ELSE p_type END AS tf
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  i AS (SELECT DISTINCT p_name AS "insert", p_type AS tf, upper(regexp_replace(p_name, '[^a-z]', '', 'g')) AS seq FROM part WHERE p_size > 10),
  c AS (SELECT r.tf, plasmid, i."insert", i.seq FROM r JOIN part ON plasmid = p_partkey AND p_size % 5 <> 0
    JOIN i ON i."insert" = p_name AND i.tf = r.tf)"""


def _panel(s: SparkSession, d: str) -> DataFrame:
    """Constructs of the tf and brand; the last word of their insert is the hit, and rings and gears count."""
    made = _made(s, d).withColumn("kind", F.split_part("insert", F.lit(" "), F.lit(2)))
    made = made.withColumn("tf", F.concat_ws("/", "tf", F.col("plasmid") % 30))
    n, k = F.length("seq"), F.length("kind")
    hits = F.array(F.struct(F.lit(9.0).alias("score"), F.col("kind").alias("family"), (n - k + 1).alias("first"), n.alias("last")))
    out = corpus.panel(made, "tf", "plasmid", "seq", F.col("plasmid") % 2 == 0, hits, ["ring", "gear", "gizmo", "widget"], "gizmo", 2)
    return out.select("tf", "plasmid", "seq", "first", "admission")


def _common(m: DataFrame) -> DataFrame:
    x, y = (metrics.average_precision(m.where(F.col("replicate") == r), "source").where("ap IS NOT NULL") for r in ("O", "F"))
    return corpus.common_groups(x.where("source % 3 <> 0"), y.where("source % 3 <> 1"), "source", "ap", ("model", "base"))


def _matrix(s: SparkSession, d: str) -> DataFrame:
    """Lines by brand and line number, as a complete matrix with coded axes."""
    cells = measurements(s, d).groupBy("cluster", "slot").agg(F.count("*").alias("n"))
    matrix, rows, _ = corpus.complete_matrix(cells, "cluster", "slot", "n")
    return matrix.join(rows, "row").select("row", "cluster", F.array_join("values", ",").alias("cells"))


def _codes(s: SparkSession, d: str) -> DataFrame:
    return ordering.codes(table(s, d, "part").withColumn("k", F.concat_ws("/", "p_brand", "p_name")), "k")


def _encoded(s: SparkSession, d: str) -> DataFrame:
    c, o = table(s, d, "customer"), table(s, d, "orders")
    named = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "o_totalprice")
    return ordering.encode(named, ordering.codes(c, "c_name"), "c_name").groupBy("code").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _borrowed(s: SparkSession, d: str) -> DataFrame:
    """Constructs of 40 letters, cut from the first 130 of a text, that need their reference's flanks."""
    docs = table(s, d, "documents").where("length(text) >= 150").select("doc_id", F.substring("text", 1, 130).alias("r"))
    docs = docs.withColumn("at", (F.col("doc_id") % 90).cast("int")).withColumn("c", F.col("r").substr(F.col("at") + 1, F.lit(40)))
    docs = docs.withColumn("f", F.lit(1)).withColumn("l", F.lit(40))
    return canonical.windows(docs, "c", "f", "l", "r", PAD).select("doc_id", "window", "origin", "env_first", "env_last", "full")


def _located(s: SparkSession, d: str) -> DataFrame:
    """Constructs of 30 letters from whole texts: as they are, with tags at both ends, or without a text."""
    docs = table(s, d, "documents").where("length(text) >= 60").select("doc_id", "text", F.substring("text", 11, 30).alias("x"))
    tagged = F.col("doc_id") % 3 == 0
    docs = docs.withColumn("c", F.when(tagged, F.concat(F.lit("\x01\x02"), "x", F.lit("\x03"))).otherwise(F.col("x")))
    docs = docs.withColumn("f", F.when(tagged, 3).otherwise(5)).withColumn("l", F.when(tagged, 32).otherwise(20))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 != 7, F.col("text")))
    return canonical.located(docs, "text", "c", "f", "l").select("doc_id", "start", "stop", "route")


def _tiles(s: SparkSession, d: str) -> DataFrame:
    """The texts' sequences, written as FASTA lines and read back in tiles by byte ranges."""
    at = f"{components.shared_folder(s)}/fasta-{uuid.uuid4().hex}"
    own = sequences(s, d).where("seq <> ''").select(F.concat_ws("\n", F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" text")), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")))
    own.write.text(at)
    path = s._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(s._jsc.hadoopConfiguration()).deleteOnExit(path)
    tiles = formats.genome(s, f"{at}/part-*", WINDOW, TILE, 1 << 20, 4096)
    return tiles.select(F.col("chrom").cast("long").alias("doc_id"), "tile", F.sha2("seq", 256).alias("digest"))


def _medoids(s: SparkSession, d: str) -> DataFrame:
    """Medoid names of each brand, by the edits between all its names."""
    own = table(s, d, "part").select(F.col("p_brand").alias("group"), F.col("p_name").alias("seq")).distinct()
    near = similar.near(own, "group", "seq", 12, whole=True)
    return corpus.sequence_medoids(near.select(F.col("family").alias("group"), "a", "b", F.col("n_edits").alias("distance")), own)


def _rebased(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("p"))
    at = corpus.rebased(F.col("p"), F.pmod("l_orderkey", F.lit(3)), F.lit(4))
    return e.select("l_orderkey", F.array_join(at["kept"], ",").alias("kept"), F.size(at["lost"]).alias("n_lost"))


def _annotated(s: SparkSession, d: str) -> DataFrame:
    inv = records.inventory(measurements(s, d)).select(F.col("cluster").alias("p_brand"), "reference", "n_entities").where("n_entities % 2 = 0")
    out = corpus.annotate(table(s, d, "part").select("p_partkey", "p_brand"), inv, "p_brand", {"reference": F.lit(-1).cast("long"), "n_entities": F.lit(1).cast("long")})
    return out.groupBy("p_brand", "reference", "n_entities").agg(F.count("*").alias("n"))


def _histogram(m: DataFrame) -> DataFrame:
    return corpus.score_histogram(m, "score", F.lit(0.35), F.lit(0.45))


def _loss(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    rows = e.select(F.col("label").alias("g"), F.round(F.col("x") * 3, 6).alias("logit"), F.round(F.col("y") * 5, 6).alias("cosine"), F.when(F.col("vec_id") % 4 == 0, 1).when(F.col("vec_id") % 4 == 3, -1).otherwise(0).alias("label"))
    return corpus.genomic_loss(rows, "g", 0.5)


def _folds(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    rows = p.select((F.col("p_partkey") % 5).alias("fold"), "p_brand", "p_size")
    kinds = p.where("p_size = 1").groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    return corpus.held_out(rows, "fold", "p_brand", kinds, "p_type", ["p_size"])


def _relatives(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    near = vectors.nearest(e, 1).select(F.col("q").alias("vec_id"), F.col("cosine").alias("identity"))
    cells = e.select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return corpus.best_relative(cells, "vec_id", ["x"], near)


def _motif_of(s: SparkSession, d: str) -> DataFrame:
    """Each language's motif, chosen on documents that are not divisible by 3."""
    labels = table(s, d, "labels").select("doc_id", F.col("quality").alias("label"))
    tf = table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("tf"))
    scans = _scan(s, d).join(labels, "doc_id").join(tf, "doc_id")
    return corpus.own_motif(scans, F.col("doc_id") % 3 != 0)


def _transfer(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    near = vectors.nearest(e, 3).withColumnRenamed("cosine", "identity")
    cells = e.select(F.col("vec_id").alias("v"), F.posexplode("embedding").alias("item", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))
    return corpus.standardised_transfer(cells, near, 2)


def _gather(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, F.col("vec_id").cast("int") % 7 + 1).alias("x"))
    out = corpus.gathered(e.where("vec_id % 3 = 0").select("vec_id"), e, "vec_id", "x")
    return out.select("vec_id", F.size("padded").alias("width"), F.size(F.filter("mask", lambda v: v)).alias("n_real"))


def _tagged(s: SparkSession, d: str) -> DataFrame:
    tags = F.concat(F.lit("arm:"), "p_brand", F.lit("-lam"), (F.col("p_size") / 10).cast("decimal(4,1)").cast("string"))
    return table(s, d, "part").select(corpus.tag(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _near_sql(most: int, group: str) -> str:
    return f"""WITH n AS (SELECT DISTINCT {group} AS family, p_name AS s FROM part)
      SELECT x.family, x.s AS a, y.s AS b, levenshtein(x.s, y.s)::BIGINT AS n_edits FROM n x JOIN n y ON x.family = y.family
        AND (length(x.s) < length(y.s) OR (length(x.s) = length(y.s) AND x.s < y.s)) WHERE levenshtein(x.s, y.s) <= {most}"""


def _near(family: str | None, most: int):
    return lambda s, d: similar.near(table(s, d, "part"), family, "p_name", most, whole=True).select("family", "a", "b", "n_edits")


CATALOG = [
    ("usable_rows", _usable(True), _usable_sql("'no_evidence'")),
    ("usable_rows_alive", _usable(False), _usable_sql("'no_evidence', 'dead_variant'")),
    ("record_names", _names, """
      WITH n AS (SELECT p_brand, p_type, min(CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END) AS name FROM part WHERE p_size > 40 GROUP BY ALL)
      SELECT p_partkey, coalesce(nullif(coalesce(n.name, CASE WHEN p_size % 4 <> 0 THEN p.p_brand END), ''), '(unnamed)') AS name
      FROM part p LEFT JOIN n ON n.p_brand = p.p_brand AND n.p_type = CASE WHEN p.p_size % 10 <> 0 THEN p.p_type END"""),
    ("experiment_constructs", _made, f"""WITH {MADE} SELECT tf, plasmid, min("insert") AS "insert", min(seq) AS seq FROM c GROUP BY ALL"""),
    ("panel_calls", _panel, f"""
      WITH {MADE}, k AS (SELECT tf || '/' || (plasmid % 30)::VARCHAR AS tf, plasmid, seq, split_part("insert", ' ', 2) AS kind FROM c),
      b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY tf ORDER BY plasmid % 2 = 0 DESC, length(seq) DESC, plasmid) = 1),
      w AS (SELECT *, greatest(length(seq) - length(kind) - 1, 1) AS pos FROM b)
      SELECT tf, plasmid, seq, CASE WHEN kind IN ('ring', 'gear', 'gizmo', 'widget') THEN pos END::INT AS first,
        CASE WHEN kind NOT IN ('ring', 'gear', 'gizmo', 'widget') THEN 'no_domain'
             WHEN regexp_matches(substr(seq, pos), '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'nonstandard'
             WHEN kind = 'gizmo' THEN 'dropped' ELSE 'accepted' END AS admission FROM w"""),
    ("common_sources", _m(_common), f"""
      WITH {M}, u AS (SELECT replicate, source, score, sum(label) AS h, count(*) AS n FROM m WHERE label <> -1 GROUP BY ALL),
      r AS (SELECT *, sum(h) OVER d AS hits, sum(n) OVER d AS rows_, sum(h) OVER w AS tot FROM u
        WINDOW d AS (PARTITION BY replicate, source ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY replicate, source)),
      g AS (SELECT replicate, source, {AP} AS ap FROM r GROUP BY ALL)
      SELECT x.source, x.ap AS model, y.ap AS base, round(x.ap - y.ap, 6) AS delta FROM g x JOIN g y ON x.source = y.source
      WHERE x.replicate = 'O' AND y.replicate = 'F' AND x.source % 3 <> 0 AND y.source % 3 <> 1 AND x.ap IS NOT NULL AND y.ap IS NOT NULL"""),
    ("complete_matrix", _matrix, f"""
      WITH {M}, c AS (SELECT cluster, slot, count(*) AS n FROM m GROUP BY ALL)
      SELECT dense_rank() OVER (ORDER BY cluster) - 1 AS "row", cluster, string_agg(n::VARCHAR, ',' ORDER BY slot) AS cells FROM c GROUP BY cluster"""),
    ("dense_codes", _codes, """
      SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT DISTINCT p_brand || '/' || p_name AS k FROM part)"""),
    ("encoded_totals", _encoded, """
      WITH c AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer))
      SELECT code, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN c USING (c_name) GROUP BY code"""),
    ("canonical_borrowed", _borrowed, f"""
      WITH d AS (SELECT doc_id, substr(text, 1, 130) AS r, doc_id % 90 AS shift FROM documents WHERE length(text) >= 150),
      c AS (SELECT *, substr(r, shift + 1, 40) AS c FROM d), p AS (SELECT *, instr(r, c) AS pos FROM c),
      w AS (SELECT *, greatest(pos - {PAD}, 1) AS lo, least(pos + 39 + {PAD}, 130) AS hi FROM p)
      SELECT doc_id, substr(r, lo, hi - lo + 1) AS "window", 'reference' AS origin, pos - lo + 1 AS env_first, pos - lo + 40 AS env_last,
        pos > {PAD} AND pos + 39 + {PAD} <= 130 AS "full" FROM w"""),
    ("located_envelopes", _located, """
      WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN text END AS t, substr(text, 11, 30) AS x, doc_id % 3 = 0 AS tagged FROM documents WHERE length(text) >= 60)
      SELECT doc_id, (instr(t, x) + CASE WHEN tagged THEN 0 ELSE 4 END)::BIGINT AS start, (instr(t, x) + CASE WHEN tagged THEN 29 ELSE 19 END)::BIGINT AS stop,
        CASE WHEN t IS NOT NULL THEN CASE WHEN tagged THEN 'domain' ELSE 'construct' END END AS route FROM d"""),
    ("genome_tiles", _tiles, f"""
      WITH {DNA}, t AS (SELECT doc_id, seq, unnest(range(0, (length(seq) - 1) // {TILE} + 1)) AS tile FROM d WHERE seq <> '')
      SELECT doc_id, tile, sha256(substr(seq, tile * {TILE} + 1, {TILE + WINDOW - 1})) AS digest FROM t"""),
    ("near_names", _near("p_type", 4), _near_sql(4, "p_type")),
    ("near_names_across", _near(None, 3), _near_sql(3, "''")),
    ("name_medoids", _medoids, """
      WITH n AS (SELECT DISTINCT p_brand AS g, p_name AS s FROM part),
      t AS (SELECT x.g, x.s, sum(levenshtein(x.s, y.s))::BIGINT AS d FROM n x JOIN n y ON x.g = y.g GROUP BY ALL)
      SELECT g AS "group", s AS medoid, d AS distance FROM t QUALIFY row_number() OVER (PARTITION BY g ORDER BY d, length(s) DESC, s) = 1"""),
    ("rebased_positions", _rebased, """
      WITH e AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS p FROM lineitem GROUP BY 1),
      m AS (SELECT l_orderkey, list_transform(p, lambda x: x - l_orderkey % 3) AS q FROM e)
      SELECT l_orderkey, array_to_string(list_filter(q, lambda x: x >= 1 AND x <= 4), ',') AS kept,
        len(list_filter(q, lambda x: x < 1 OR x > 4))::INT AS n_lost FROM m"""),
    ("annotated_parts", _annotated, f"""
      WITH {M}, i AS (SELECT cluster, count(DISTINCT entity) AS n_entities, (array_agg(entity ORDER BY n_mut, entity))[1] AS reference FROM m GROUP BY cluster)
      SELECT p_brand, coalesce(reference, -1) AS reference, coalesce(n_entities, 1) AS n_entities, count(*) AS n
      FROM part LEFT JOIN i ON p_brand = cluster AND n_entities % 2 = 0 GROUP BY ALL"""),
    ("marked_histogram", _m(_histogram), f"""
      WITH {M}, e AS (SELECT floor(min(score) * 20) / 20 AS lo, ceil(max(score) * 20) / 20 AS hi FROM m),
      w AS (SELECT lo, (hi - lo) / 40 AS w, unnest(range(40)) AS bin FROM e),
      c AS (SELECT least(floor(round((score - lo) / ((hi - lo) / 40), 9)), 39)::BIGINT AS bin, count(*) AS n FROM m CROSS JOIN e GROUP BY 1)
      SELECT w.bin, round(lo + w.bin * w, 6) AS edge, coalesce(n, 0) AS n,
        CASE WHEN floor(round((0.45 - lo) / w, 9)) = w.bin THEN '>' WHEN floor(round((0.35 - lo) / w, 9)) = w.bin THEN '<' ELSE '' END AS mark
      FROM w LEFT JOIN c ON c.bin = w.bin"""),
    ("records_nulls_first", _m(lambda m: corpus.nulls_first(metrics.average_precision(m, "entity").join(records.inventory(m).select(F.col("reference").alias("entity"), "cluster"), "entity").withColumn("half", F.substring("cluster", 1, 7)), "half", "ap", "entity").select("entity", "half", "ap", "place")), f"""
      WITH {RUNS.replace("source", "entity")}, g AS (SELECT entity, {AP} AS ap FROM r GROUP BY entity),
      i AS (SELECT cluster, (array_agg(entity ORDER BY n_mut, entity))[1] AS entity FROM m GROUP BY cluster)
      SELECT entity, substr(cluster, 1, 7) AS half, ap, row_number() OVER (PARTITION BY substr(cluster, 1, 7) ORDER BY ap NULLS FIRST, entity)::INT AS place FROM g JOIN i USING (entity)"""),
    ("genomic_loss", _loss, """
      WITH e AS (SELECT label AS g, round(embedding[1]::DOUBLE * 3, 6) AS x, round(embedding[2]::DOUBLE * 5, 6) AS c,
          CASE vec_id % 4 WHEN 0 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS y FROM embeddings), o AS (SELECT * FROM e WHERE y >= 0),
      n AS (SELECT g, max(c) AS top FROM o WHERE y = 0 GROUP BY g), a AS (SELECT o.g, any_value(top) + ln(sum(exp(c - top))) AS every FROM o JOIN n ON o.g = n.g WHERE y = 0 GROUP BY o.g),
      p AS (SELECT o.g, avg(greatest(every - c, 0) + ln(1 + exp(-abs(every - c)))) AS x FROM o JOIN a ON o.g = a.g WHERE y = 1 GROUP BY o.g),
      b AS (SELECT avg(greatest(x, 0) + ln(1 + exp(-abs(x))) - y * x) AS bce FROM o)
      SELECT round(bce, 5) AS bce, round(nce, 5) AS nce, round(bce + 0.5 * nce, 5) AS loss FROM b CROSS JOIN (SELECT coalesce(avg(x), 0) AS nce FROM p)"""),
    ("held_out_folds", _folds, """
      WITH k AS (SELECT p_brand, min(p_type) AS kind FROM part WHERE p_size = 1 GROUP BY 1)
      SELECT p_partkey % 5 AS fold, count(DISTINCT p.p_brand) AS n_members, array_to_string(list_sort(list(DISTINCT coalesce(kind, '?'))), ', ') AS families,
        round(avg(p_size), 6) AS p_size FROM part p LEFT JOIN k USING (p_brand) GROUP BY 1"""),
    ("best_relatives", _relatives, f"""
      WITH {BOTH}, t AS (SELECT q, max(cosine) AS identity FROM b GROUP BY q),
      x AS (SELECT vec_id, avg(v) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1)
      SELECT vec_id, round(x, 6) AS x, identity FROM x LEFT JOIN t ON q = vec_id"""),
    ("training_motifs", _motif_of, f"""
      WITH {SCAN}, s AS (SELECT coalesce(lang, '?') AS tf, motif || ':best' AS choice, best AS score, quality AS label FROM z JOIN labels USING (doc_id) JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0
          UNION ALL SELECT coalesce(lang, '?'), motif || ':total', total, quality FROM z JOIN labels USING (doc_id) JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0),
      f AS (SELECT tf, choice, score, sum(label) AS h, count(*) AS n FROM s WHERE label <> -1 GROUP BY ALL),
      r AS (SELECT *, sum(h) OVER e AS hits, sum(n) OVER e AS rows_, sum(h) OVER g AS tot FROM f
        WINDOW e AS (PARTITION BY tf, choice ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY tf, choice)),
      a AS (SELECT tf, choice, {AP} AS ap FROM r GROUP BY ALL)
      SELECT tf, choice, ap FROM a QUALIFY row_number() OVER (PARTITION BY tf ORDER BY ap DESC NULLS LAST, choice) = 1"""),
    ("standardised_transfer", _transfer, f"""
      WITH {BOTH}, k AS (SELECT q, v, greatest(cosine, 0.0) AS w FROM b QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) <= 2),
      x AS (SELECT vec_id AS v, unnest(range(len(embedding)))::INT AS item, round(unnest(embedding)::DOUBLE, 4) AS x FROM embeddings),
      z AS (SELECT v, item, round((x - avg(x) OVER o) / CASE WHEN stddev_pop(x) OVER o = 0 THEN 1 ELSE stddev_pop(x) OVER o END, 5) AS z FROM x WINDOW o AS (PARTITION BY v))
      SELECT q, item, round(coalesce(sum(w * z) / nullif(sum(w), 0), avg(z)), 5) AS value FROM k JOIN z USING (v) GROUP BY q, item"""),
    ("gathered_vectors", _gather, """
      SELECT vec_id, max(least(vec_id % 7 + 1, len(embedding))) OVER ()::INT AS width, least(vec_id % 7 + 1, len(embedding))::INT AS n_real FROM embeddings WHERE vec_id % 3 = 0"""),
    ("file_tags", _tagged, """
      SELECT 'arm-' || p_brand || '-lam' || replace((p_size / 10)::DECIMAL(4, 1)::VARCHAR, '.', 'p') AS tag, count(*) AS n FROM part GROUP BY 1"""),
    ("code_stamps", lambda s, d: corpus.stamps(table(s, d, "orders"), "o_orderstatus", "o_custkey"), """
      SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS stamps, count(DISTINCT o_orderstatus)::INT AS n
      FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1"""),
    ("expected_null", _m(lambda m: evaluation.expected_null(m, "source")), f"""
      WITH {M}, g AS (SELECT source, sum(label) AS k, count(*) AS n FROM m WHERE label <> -1 GROUP BY 1 HAVING sum(label) > 0),
      h AS (SELECT k, n, list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i)) AS h FROM g)
      SELECT count(*) AS n_groups, round(avg((h + CASE WHEN n > 1 THEN (k - 1) / (n - 1) * (n - h) ELSE 0 END) / n), 6) AS expected_ap FROM h"""),
    ("sampled_null_band", _m(lambda m: evaluation.null_band(evaluation.sampled_null(m, "source", 200))), None),
    ("starved_sizes", lambda s, d: reports.starved(table(s, d, "part"), "p_size", F.col("p_size") > 20), """
      SELECT p_size, count(*) AS n FROM part WHERE p_size > 20 GROUP BY 1"""),
    ("absent_keys", lambda s, d: reports.missing_keys(table(s, d, "documents"), table(s, d, "labels"), "doc_id"), """
      SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)"""),
    ("silent_sources", _m(lambda m: metrics.average_precision(m.withColumn("label", F.when(F.col("source") % 2 == 0, 0).otherwise(F.col("label"))), "source").where("ap IS NULL OR ap < 0.5").select("source", F.when(F.col("ap").isNull(), "dead").otherwise("low").alias("reason"))), f"""
      WITH {M}, u AS (SELECT source, score, sum(CASE WHEN source % 2 = 0 THEN 0 ELSE label END) AS h, count(*) AS n FROM m WHERE source % 2 = 0 OR label <> -1 GROUP BY ALL),
      r AS (SELECT *, sum(h) OVER d AS hits, sum(n) OVER d AS rows_, sum(h) OVER w AS tot FROM u
        WINDOW d AS (PARTITION BY source ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY source)),
      g AS (SELECT source, {AP} AS ap FROM r GROUP BY source)
      SELECT source, CASE WHEN ap IS NULL THEN 'dead' ELSE 'low' END AS reason FROM g WHERE ap IS NULL OR ap < 0.5"""),
]
