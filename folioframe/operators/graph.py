"""Entities and relations: rule-based extraction, deduplication, co-occurrence, and queries of the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioframe.functions import values as V
from folioframe.operators.skew import meetings
from folioframe.stash import Stash

# Capitalised words that name nothing, and noise terms.
COMMON = (
    "The This That These Those There Then They Their When Where What Which While With Without Within Who Why How Here His Her Its It If In Into Is Are As At An A And Or But By For From Of On Our To Under Up We You "
    "Both Between Each Every Neither Nor Most More Many Some Any All No Not After Before Please According Whoever Also See One Two Three First Second Last Next New Old Other Such Only Because Since Until Unless Although However"
).split()
NOISE = "true false null none todo fixme http https www com org html css json xml pdf doc docx xlsx png jpg".split()


def usable_name(name: Column) -> Column:
    """2 to 100 characters, two letters at least, not all digits, no line break, at most eight blanks, no noise word."""
    n = F.trim(name)
    letters = F.length(F.regexp_replace(n, r"[^\p{L}]", ""))
    blanks = F.length(n) - F.length(F.replace(n, F.lit(" ")))
    return (F.length(n) >= 2) & (F.length(n) <= 100) & (letters >= 2) & ~n.contains("\n") & (blanks <= 8) & ~F.lower(n).isin(*NOISE)


def entity_names(text: Column) -> Column:
    """Names a text holds: capitalised words, capitals of three letters and more, and quoted terms (corner brackets and curly
    quotes of 2 to 20 characters, straight quotes of up to five words). Texts are read whole, however long."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][\p{L}\p{N}]+)\b"), 1), lambda w: ~w.isin(*COMMON))
    capitals = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{3,})\b"), 1)
    corner = F.regexp_extract_all(text, F.lit(r"「([^」\n]{2,20})」"), 1)
    curly = F.regexp_extract_all(text, F.lit("“([^”\\n]{2,20})”"), 1)
    straight = F.filter(F.regexp_extract_all(text, F.lit(r'"([^"\n]{2,60})"'), 1), lambda w: F.size(F.split(F.trim(w), r"\s+")) <= 5)
    return F.array_distinct(F.filter(F.concat(words, capitals, corner, curly, straight), usable_name))


def extract_entities(chunks: DataFrame) -> DataFrame:
    """Mentions of entities by rule: entity_id (lower case), name, entity_type, source_file, chunk_id."""
    rows = chunks.where(~F.col("id").endswith("-doc-summary")).select("id", "file_path", F.explode(entity_names(F.col("text"))).alias("name"))
    kind = F.when(F.col("name").rlike(r"^[A-Z0-9]{2,}$"), "Technology").otherwise("Concept")
    return rows.select(F.lower(F.trim("name")).alias("entity_id"), F.trim("name").alias("name"), kind.alias("entity_type"), F.col("file_path").alias("source_file"), F.col("id").alias("chunk_id"))


def extract_with_model(chunks: DataFrame, provider, least_bytes: int = 200) -> DataFrame:
    """Like ``extract_entities``, but texts of ``least_bytes`` bytes and more go to ``provider`` (a Column function that gives
    a model's answer); answers without a JSON object fall back to the rules."""
    long = F.octet_length("text") >= least_bytes
    asked = chunks.where(long).withColumn("answer", V.parse_graph_answer(provider(F.col("text"))))
    named = asked.where("answer is not null").select(F.explode("answer.entities").alias("e"), "file_path", "id").where(F.octet_length("e.name") >= 2)
    told = named.select(F.lower("e.name").alias("entity_id"), F.col("e.name").alias("name"), V.entity_type(F.col("e.type")).alias("entity_type"), F.col("file_path").alias("source_file"), F.col("id").alias("chunk_id"))
    by_rule = chunks.where(~long | F.col("text").isNull()).unionByName(asked.where("answer is null").drop("answer"))
    return told.unionByName(extract_entities(by_rule))


def distinct_entities(mentions: DataFrame, order: Column) -> DataFrame:
    """One row per entity: the first name by ``order``, and the first type that isn't Concept, if there is one."""
    kind = V.entity_type(F.col("entity_type"))
    rows = mentions.where("entity_id is not null").withColumn("o", order).withColumn("kind", kind)
    named = rows.where("name is not null")
    names = named.groupBy("entity_id").agg(F.min(F.struct("o", "name")).alias("m")).select("entity_id", F.col("m.name").alias("name"))
    kinds = rows.groupBy("entity_id").agg(F.min(F.when(F.col("kind") != "Concept", F.struct("o", "kind"))).alias("m"), F.count(F.lit(1)).alias("mentions"))
    return kinds.join(names, "entity_id", "left").select("entity_id", "name", F.coalesce("m.kind", F.lit("Concept")).alias("entity_type"), "mentions")


def cooccurrence_relations(mentions: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Relations between all entities of a chunk, each unordered pair once per file: the file of the chunk is kept."""
    m = mentions.where("chunk_id is not null and entity_id is not null and source_file is not null").select(F.struct("chunk_id", "source_file").alias("k"), "entity_id", "source_file").distinct()
    # chunks with many entities are met in parts
    met = [x.alias("a").join(y.alias("b"), on).where(F.col("a.entity_id") < F.col("b.entity_id")).select("a.entity_id", "b.entity_id", "a.source_file").toDF("x", "y", "f") for x, y, on in meetings(Stash(mentions.sparkSession).put(m), "k", "entity_id", 512)]
    pairs = reduce(DataFrame.unionByName, met)
    return pairs.select(F.col("x").alias("from_entity"), F.col("y").alias("to_entity"), F.lit("co-occurrence").alias("relation_type"), F.col("f").alias("source_file"), F.lit(confidence).alias("confidence")).distinct()


def degrees(relations: DataFrame) -> DataFrame:
    """Number of distinct relations (from, to, type) at each entity, counted from both ends: entity_id, ``degree``."""
    edges = relations.where("from_entity is not null and to_entity is not null").select("from_entity", "to_entity", "relation_type").distinct()
    ends = edges.select(F.col("from_entity").alias("entity_id")).unionByName(edges.select(F.col("to_entity").alias("entity_id")))
    return ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def top_entities(relations: DataFrame, n: int = 20) -> DataFrame:
    return degrees(relations).orderBy(F.desc("degree"), "entity_id").limit(n)


def relation_histogram(relations: DataFrame) -> DataFrame:
    return relations.groupBy(V.relation_type(F.col("relation_type")).alias("relation_type")).agg(F.count(F.lit(1)).alias("n"))


def one_hop(relations: DataFrame, entity: str, *, least_confidence: float | None = None, n: int = 10) -> DataFrame:
    """Entities related to one, in either direction, best connected first: entity_id, relation_type, ``degree``."""
    rows = relations if least_confidence is None else relations.where(F.col("confidence") >= least_confidence)
    out = rows.where(F.col("from_entity") == entity).select(F.col("to_entity").alias("entity_id"), "relation_type")
    back = rows.where(F.col("to_entity") == entity).select(F.col("from_entity").alias("entity_id"), "relation_type")
    near = out.union(back).where(F.col("entity_id") != entity).distinct()
    return near.join(degrees(relations), "entity_id").orderBy(F.desc("degree"), "entity_id", "relation_type").limit(n)


def two_hops(relations: DataFrame, entity: str) -> DataFrame:
    """Entities within two steps and the least number of steps: entity_id, ``depth``. One join per step, no recursion."""
    edges = relations.where("from_entity is not null and to_entity is not null and from_entity != to_entity").select(F.col("from_entity").alias("a"), F.col("to_entity").alias("b")).distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    first = both.where(F.col("a") == entity).select(F.col("b").alias("entity_id")).distinct()
    second = both.join(first, both["a"] == first["entity_id"], "left_semi").select(F.col("b").alias("entity_id")).distinct()
    all_ = first.withColumn("depth", F.lit(1)).unionByName(second.withColumn("depth", F.lit(2))).where(F.col("entity_id") != entity)
    return all_.groupBy("entity_id").agg(F.min("depth").alias("depth"))


def induced_graph(relations: DataFrame, n: int = 20) -> DataFrame:
    """Edges among the ``n`` best connected entities: from_entity, to_entity, relation_type, ``weight`` (rows)."""
    top = F.broadcast(top_entities(relations, n).select("entity_id"))  # n rows
    inside = relations.join(top, F.col("from_entity") == top["entity_id"], "left_semi").join(top, F.col("to_entity") == top["entity_id"], "left_semi")
    return inside.groupBy("from_entity", "to_entity", "relation_type").agg(F.count(F.lit(1)).alias("weight"))


def chunks_of(mentions: DataFrame, entity: str) -> DataFrame:
    return mentions.where((F.col("entity_id") == entity) & F.col("chunk_id").isNotNull()).select("chunk_id").distinct()


def keep_latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Upsert as of now: of rows with the same key the last written one."""
    w = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def relation_lines(relations: DataFrame, entities: DataFrame, words: list[str], each: int = 5) -> DataFrame:
    """Lines that describe up to ``each`` relations of each of up to five words: entity_id, ``line``; joins relations with
    entities at both ends, in both directions."""
    few = words[:5]
    names = entities.select("entity_id", "name")
    hit = relations.where(F.col("from_entity").isin(few) | F.col("to_entity").isin(few)).select("from_entity", "to_entity", "relation_type").distinct()
    told = hit.join(names.withColumnsRenamed({"entity_id": "from_entity", "name": "from_name"}), "from_entity").join(names.withColumnsRenamed({"entity_id": "to_entity", "name": "to_name"}), "to_entity")
    line = F.format_string("%s -[%s]-> %s", "from_name", "relation_type", "to_name")
    ends = told.select("from_entity", "to_entity", line.alias("line")).withColumn("entity_id", F.explode(F.array("from_entity", "to_entity"))).where(F.col("entity_id").isin(few))
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy("line"))
    return ends.select("entity_id", "line").distinct().withColumn("n", n).where(F.col("n") <= each).drop("n")
