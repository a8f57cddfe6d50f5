"""Who is who: mentions, blocking, complete-linkage clusters, roles, confidence, continuity."""

from __future__ import annotations

from itertools import combinations
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.names import base_similarity, name_parts, name_similarity, split_parties
from ..functions.tamil import garbled, transliterate
from ..functions.variants import each, text_of

if TYPE_CHECKING:
    from ..sources.cases import CaseTables

#: Likeness from which mentions merge; letters of a block key.
MERGE, BLOCK = 0.50, 1
#: Bands of a cluster's confidence.
BANDS = (("HIGH", 0.85), ("MODERATE", 0.70), ("LOW", 0.50))
#: What roles are called.
ROLES = {
    "buyer": "Buyer",
    "seller": "Seller",
    "patta_owner": "Patta Owner",
    "ec_claimant": "EC Claimant/Buyer",
    "ec_executant": "EC Executant/Seller",
    "party": "Party",
}
#: A lone mention's confidence; what files, kinds of documents and one given name add.
ALONE, PER_FILE, FILES_AT_MOST, KINDS, ONE_GIVEN = 0.50, 0.10, 0.30, 0.10, 0.05


# mentions


def mentions(t: CaseTables) -> DataFrame:
    """Every person that a record names: case_id, at (order in the case), name, role, source, date, quality."""
    blank = F.lit("")
    trimmed = ["case_id", "doc_ord", "source_file", "source_type", "role", "side", "pos", "k", "name", "date", "transaction_id"]

    def row(df: DataFrame, kind: Column, role: Column, side: Column, pos: Column, k: Column, name: Column, date: Column = blank, tid: Column = blank) -> DataFrame:
        cols = [F.col("case_id"), F.col("doc_ord"), F.col("filename"), kind, role, side.cast("int"), pos.cast("int"), k.cast("int"), F.trim(name), F.coalesce(date, blank), F.coalesce(tid, blank)]
        return df.select(*(c.alias(n) for c, n in zip(cols, trimmed)))

    zero = F.lit(0)
    deed = row(t.parties, F.lit("SALE_DEED"), F.col("role"), (F.col("role") == "buyer").cast("int"), F.col("pos"), zero, F.col("name"))
    owner = row(t.owners, F.col("document_type"), F.lit("patta_owner"), zero, F.col("pos"), zero, F.col("name"))
    sides = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(i).alias("side"), F.coalesce(split_parties(F.col(c)), F.array().cast("array<string>")).alias("names")) for i, (r, c) in enumerate((("ec_executant", "seller_or_executant"), ("ec_claimant", "buyer_or_claimant")))))
    split = t.transactions.select("case_id", "doc_ord", "filename", "pos", "date", "transaction_id", F.inline(sides)).select("*", F.posexplode("names").alias("k", "name"))
    # a certificate lists executants and claimants row by row
    ec = row(split, F.lit("EC"), F.col("role"), zero, F.col("pos"), F.col("side") * 1000 + F.col("k"), F.col("name"), F.col("date"), F.col("transaction_id"))
    rest = t.documents.where(~F.col("document_type").isin("SALE_DEED", "EC", "PATTA", "CHITTA", "A_REGISTER"))
    read = rest.select("case_id", "doc_ord", "filename", "document_type", F.explode(F.array(F.try_parse_json("data"))).alias("_v"))
    others = read.select("case_id", "doc_ord", "filename", "document_type", F.posexplode(F.transform(each(F.col("_v"), "key_parties"), text_of)).alias("pos", "name"))
    party = row(others, F.col("document_type"), F.lit("party"), zero, F.col("pos"), zero, F.col("name"))
    out = deed.unionByName(owner).unionByName(ec).unionByName(party).where("name <> ''")
    w = Window.partitionBy("case_id").orderBy("doc_ord", "side", "pos", "k", "role", "name")
    return out.select("case_id", "doc_ord", "source_file", "source_type", "role", "name", "date", "transaction_id", mention_quality(F.col("name")).alias("quality"), F.row_number().over(w).alias("at"))


def mention_quality(name: Column) -> Column:
    """1 for a sound name; a damaged one's own quality, 0.3 at least."""
    g = garbled(name)
    return F.when(g["is_garbled"], F.greatest(F.lit(0.3), g["quality"])).otherwise(F.lit(1.0))


# clusters


def block_keys(name: Column, latin: Column | None = None) -> Column:
    """First letters of the words of a given name, without initials; of its Latin spelling too."""
    given = name_parts(name)["given"]
    raw = F.when(given != "", given).otherwise(F.lower(F.trim(name)))
    bare = F.trim(F.regexp_replace(raw, r"\b[a-z]\.\s*", ""))
    words = F.split(F.when(bare != "", bare).otherwise(raw), r"\s+")
    if latin is not None:
        words = F.concat(words, F.split(F.lower(F.trim(latin)), r"\s+"))
    keys = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= BLOCK), lambda w: F.substr(w, F.lit(1), F.lit(BLOCK))))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("_")))


def pairs(people: DataFrame, by: str, pos: str, name: str) -> DataFrame:
    """Pairs of names of a case that share a block, with their likeness."""
    spelled = people.select(by, F.col(pos).alias("pos"), F.col(name).alias("name"), transliterate(F.col(name)).alias("latin"))
    keyed = spelled.select(by, "pos", "name", F.explode(block_keys(F.col("name"), F.col("latin"))).alias("block"))
    a = keyed.select(by, "block", F.col("pos").alias("a"), F.col("name").alias("name_a"))
    b = keyed.select(by, "block", F.col("pos").alias("b"), F.col("name").alias("name_b"))
    met = a.join(b, [by, "block"]).where("a < b").select(by, "a", "b", "name_a", "name_b").distinct()
    return met.withColumn("similarity", name_similarity("name_a", "name_b"))


def _components(n: int, edges: dict[tuple[int, int], float]) -> list[list[int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in edges:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    out: dict[int, list[int]] = {}
    for x in range(n):
        out.setdefault(find(x), []).append(x)
    return [c for c in out.values() if len(c) > 1]


def link(n: int, edges: dict[tuple[int, int], float], least: float = MERGE) -> list[int]:
    """Complete linkage: the most alike clusters merge while all their pairs are alike enough.

    Clusters never leave a connected component of alike pairs, so each is merged by
    itself; a row's best partner is looked up again only if it was merged away.
    """
    alike = {k: s for k, s in edges.items() if s >= least}
    label = list(range(n))
    for part in _components(n, alike):
        at = {x: i for i, x in enumerate(part)}
        sim = np.full((len(part), len(part)), -1.0)
        for (i, j), s in alike.items():
            if i in at:
                sim[at[i], at[j]] = sim[at[j], at[i]] = s
        own = np.arange(len(part))
        best = sim.argmax(1)
        top = sim[own, best]
        while True:
            i = int(top.argmax())
            if top[i] < least:
                break
            i, j = sorted((i, int(best[i])))
            sim[i] = sim[:, i] = np.minimum(sim[i], sim[j])
            sim[j] = sim[:, j] = -1
            sim[i, i] = -1
            for x in np.flatnonzero(np.isin(best, (i, j)) | np.isin(own, (i, j))):
                best[x] = sim[x].argmax()
                top[x] = sim[x, best[x]]
            label = [part[i] if x == part[j] else x for x in label]
    return label


def clusters(people: DataFrame, by: str, pos: str, name: str) -> DataFrame:
    """by, pos, cluster_id: the least position of each cluster.

    Equal names are one point: they are wholly alike, and like others alike. A case's
    alike pairs of different names are one group.
    """
    named = people.select(by, F.col(pos).alias("pos"), F.col(name).alias("name"))
    names = named.groupBy(by, "name").agg(F.min("pos").alias("first"))
    scored = pairs(names, by, "first", "name").where(F.col("similarity") >= MERGE).select(by, "a", "b", "similarity")
    kind, at = named.schema[by].dataType.simpleString(), named.schema["pos"].dataType.simpleString()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        where = sorted({*pdf["a"], *pdf["b"]})
        index = {p: i for i, p in enumerate(where)}
        label = link(len(where), {(index[a], index[b]): s for a, b, s in zip(pdf["a"], pdf["b"], pdf["similarity"])})
        moved = [(p, where[x]) for p, x in zip(where, label) if where[x] != p]
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(moved), "first": [p for p, _ in moved], "to": [x for _, x in moved]})

    moves = scored.groupBy(by).applyInPandas(merge, f"{by} {kind}, first {at}, to {at}")
    labelled = names.join(moves, [by, "first"], "left").select(by, "name", F.coalesce("to", "first").alias("cluster_id"))
    return named.join(labelled, [by, "name"]).select(by, "pos", "cluster_id")


def resolve(t: CaseTables) -> DataFrame:
    """The mentions of all cases with the cluster that each belongs to."""
    people = t._kept(mentions(t))
    return people.join(clusters(people, "case_id", "at", "name").withColumnRenamed("pos", "at"), ["case_id", "at"])


def shared_roles(resolved: DataFrame) -> DataFrame:
    """case_id, and the roles of each of its clusters."""
    own = resolved.groupBy("case_id", "cluster_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return own.groupBy("case_id").agg(F.array_sort(F.collect_list("roles")).alias("clusters"))


def with_role(summaries: DataFrame, role: str) -> DataFrame:
    """Clusters with a mention in a role."""
    return summaries.where(F.array_contains("roles", role))


# what a cluster tells


def confidence_band(score: Column) -> Column:
    return F.coalesce(*(F.when(score >= least, F.lit(name)) for name, least in BANDS), F.lit("VERY_LOW"))


def consensus(people: DataFrame, by: list[str], name: str, quality: str) -> DataFrame:
    """The best name of a cluster: of sound text, with a patronymic, long."""
    parts = name_parts(F.col(name))
    best = F.struct((F.col(quality) > 0.5).cast("int"), (parts["patronymic"] != "").cast("int"), F.length(name), -F.col(quality), F.col(name))
    return people.groupBy(*by).agg(
        F.max_by(name, best).alias("consensus_name"), F.count("*").alias("mention_count"), F.countDistinct("source_file").alias("n_files"), F.array_sort(F.collect_set("role")).alias("roles")
    )


@pandas_udf(T.BooleanType())
def all_alike(names: pd.Series) -> pd.Series:
    """Whether all pairs of a list of given names are alike enough."""
    return names.map(lambda own: all(base_similarity(a, b) >= MERGE for a, b in combinations(own, 2)))


def confidence(n_files: Column, n_kinds: Column, one_given: Column, quality: Column) -> Column:
    """What corroborates a cluster, scaled down for damaged text."""
    base = F.lit(ALONE) + F.least(F.lit(FILES_AT_MOST), PER_FILE * (n_files - 1)) + F.when(n_kinds >= 2, KINDS).otherwise(0.0) + F.when(one_given, ONE_GIVEN).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(quality < 0.7, base * (0.6 + 0.4 * quality)).otherwise(base))


def summaries(resolved: DataFrame) -> DataFrame:
    """A row per cluster: consensus, confidence and band, roles, sources, evidence lines."""
    given = name_parts(F.col("name"))["given"]
    keys = ["case_id", "cluster_id"]
    m = resolved.withColumn("given", given)
    shown = lambda r: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), r), r)
    line = F.concat(
        F.lit("'"), F.col("name"), F.lit("' in "), F.col("source_type"), F.lit(" ["), F.col("source_file"), F.lit("]"),
        F.when(F.col("date") != "", F.concat(F.lit(" ("), F.col("date"), F.lit(")"))).otherwise(""),
        F.lit(" as "), shown(F.col("role")), F.when(F.col("quality") < 0.5, " [garbled]").otherwise(""),
    )
    g = m.groupBy(*keys).agg(
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
        F.array_sort(F.collect_set("source_type")).alias("source_types"),
        F.avg("quality").alias("quality"),
        F.count_if(F.col("given") != "").alias("n_given"),
        F.array_sort(F.collect_set(F.when(F.col("given") != "", F.col("given")))).alias("givens"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))), lambda x: x["l"]).alias("evidence"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(shown(F.col("role")), F.lit(" ("), F.col("source_type"), F.lit(")")).alias("l")))), lambda x: x["l"])).alias("appears_as"),
    )
    g = g.withColumn("one_given", (F.col("n_given") >= 2) & all_alike("givens"))
    score = confidence(F.size("source_files"), F.size("source_types"), F.col("one_given"), F.col("quality"))
    out = g.join(consensus(m, keys, "name", "quality"), keys).withColumn("confidence", score)
    return out.withColumn("confidence_band", confidence_band(F.col("confidence")))


def best_cluster(names: DataFrame, resolved: DataFrame, least: float = MERGE) -> DataFrame:
    """case_id, name -> the cluster with the likest mention, if any is likelier than ``least``."""
    known = resolved.select("case_id", "cluster_id", F.col("name").alias("mention")).distinct()
    met = names.select("case_id", "name").distinct().join(known, "case_id").withColumn("s", name_similarity("name", "mention")).where(F.col("s") > least)
    return met.groupBy("case_id", "name").agg(F.min_by("cluster_id", F.struct(-F.col("s"), "cluster_id")).alias("cluster_id"), F.max("s").alias("similarity"))


def panel(summary: DataFrame, by: list[str]) -> DataFrame:
    """Figures over the clusters: mentions, mean confidence, sources, sure ones."""
    return summary.groupBy(*by).agg(
        F.count("*").alias("n_clusters"), F.sum("mention_count").alias("n_mentions"), F.avg("confidence").alias("mean_confidence"),
        F.size(F.array_distinct(F.flatten(F.collect_list("source_files")))).alias("n_sources"), F.count_if(F.col("confidence_band") == "HIGH").alias("n_high"),
    )


def prompt_text(summary: DataFrame) -> DataFrame:
    """A case's clusters as lines."""
    line = F.concat(F.lit("- "), F.col("consensus_name"), F.lit(": "), F.array_join("appears_as", ", "), F.format_string(" (%.0f%%, %s)", F.col("confidence") * 100, F.col("confidence_band")))
    return summary.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("clusters"))


# continuity


def chain_breaks(transfers: DataFrame, by: str, order: list[str], seller: str, buyer: str, least: float = MERGE, cluster_of: DataFrame | None = None) -> DataFrame:
    """Transfers whose next one is sold by nobody like a buyer; parties are split.

    ``cluster_of``: by, name, cluster_id; names of one cluster are the same person.
    """
    w = Window.partitionBy(by).orderBy(*order)
    following = transfers.withColumn("next_seller", F.lead(seller).over(w)).withColumn("_row", F.row_number().over(w))
    asked = following.where((F.trim(buyer) != "") & (F.trim("next_seller") != ""))
    met = asked.select(by, "_row", F.explode(split_parties(F.col(buyer))).alias("_b"), "next_seller").select(by, "_row", "_b", F.explode(split_parties(F.col("next_seller"))).alias("_s"))
    likeness = met.select(by, "_b", "_s").distinct().withColumn("_like", name_similarity("_b", "_s"))
    scored = met.join(likeness, [by, "_b", "_s"])
    if cluster_of is not None:
        for side, out in (("_b", "_cb"), ("_s", "_cs")):
            scored = scored.join(cluster_of.select(by, F.col("name").alias(side), F.col("cluster_id").alias(out)), [by, side], "left")
        scored = scored.withColumn("_like", F.when(F.col("_cb") == F.col("_cs"), F.greatest("_like", F.lit(1.0))).otherwise(F.col("_like")))
    best = scored.groupBy(by, "_row").agg(F.max("_like").alias("similarity"))
    return asked.join(best, [by, "_row"]).where(F.col("similarity") < least).drop("_row")
