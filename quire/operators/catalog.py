"""Listing, lookup and summary operators over relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import cut


def with_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, out: str) -> DataFrame:
    """`parents` with the number of their children (0 kept); children are counted before the join."""
    counted = children.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(out))
    return parents.join(counted, key, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key by `order`: an aggregate, so that no key's rows are sorted in one task."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def without(df: DataFrame, other: DataFrame, on: str, other_on: str) -> DataFrame:
    return df.join(other.select(F.col(other_on).alias(on)).distinct(), on, "left_anti")


def unknown_endpoints(edges: DataFrame, a: str, b: str, known_a: DataFrame, known_b: DataFrame) -> DataFrame:
    """Edges of which an end is not known (`known_*`: one id column)."""
    ka = known_a.toDF("_a").distinct().withColumn("_ia", F.lit(1))
    kb = known_b.toDF("_b").distinct().withColumn("_ib", F.lit(1))
    joined = edges.join(ka, edges[a] == ka["_a"], "left").join(kb, edges[b] == kb["_b"], "left")
    return joined.where("_ia IS NULL OR _ib IS NULL").drop("_a", "_b", "_ia", "_ib")


def missing_members(df: DataFrame, key: str, members: str, known: DataFrame, known_key: str, known_member: str) -> DataFrame:
    """(key, missing): members of the array that the key does not have in `known`, in order."""
    rows = df.select(key, F.posexplode(members).alias("_at", "_m"))
    left = rows.join(known.select(F.col(known_key).alias(key), F.col(known_member).alias("_m")).distinct(), [key, "_m"], "left_anti")
    return left.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda s: s["_m"]).alias("missing"))


def overlapping(df: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    return df.where((F.col(end) >= low) & (F.col(start) <= high))


def page_of(df: DataFrame, order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an ordered listing (1 to 200 rows)."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset is not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of the values; no values, no rows."""
    return df.where(F.col(column).isin(values) if values else F.lit(False))


def edges_of(edges: DataFrame, a: str, kind: str, b: str) -> DataFrame:
    """Each edge from either end: (entity, direction, kind, other)."""
    out = edges.select(F.col(a).alias("entity"), F.lit("out").alias("direction"), F.col(kind).alias("kind"), F.col(b).alias("other"))
    return out.unionByName(edges.select(F.col(b).alias("entity"), F.lit("in").alias("direction"), F.col(kind).alias("kind"), F.col(a).alias("other")))


def lookup(df: DataFrame, key_columns: list[str], wanted: Column, fold, id_column: str) -> DataFrame:
    """Rows one of whose folded columns is the folded key, once each, with the number of rows found."""
    hit = F.array_contains(F.array(*(fold(F.col(c)) for c in key_columns)), fold(wanted))
    found = cut(df.where(hit).dropDuplicates([id_column]))  # rows are folded once, for themselves and for their number
    return found.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("matches"))))  # one row


def last_of(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row of each key: the last by `order`, else the greatest by its other columns."""
    cols = [c for c in df.columns if c not in keys]
    if not cols:
        return df.distinct()
    by = [order, *(c for c in cols if c != order)] if order else cols
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*by)).alias("_v")).select(*(F.col(f"_v.{c}").alias(c) if c in cols else F.col(c) for c in df.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """`old` with the rows of `new` in place of those with their keys; columns in `keep` stay as they were.

    Of rows of `new` with one key the last by its column `order` counts.
    """
    new = last_of(new, keys, order)
    for c in keep:
        prior = old.select(*keys, F.col(c).alias(f"_{c}"))
        new = new.join(prior, keys, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose keys it lacks, one of each key."""
    return old.unionByName(last_of(new, keys).join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def update_fields(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Fields of `changes` that are not null take the place of the old ones."""
    fields = [c for c in changes.columns if c != key]
    renamed = last_of(changes, [key]).select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return old.join(renamed, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table (with its foreign key) without the rows that point to `gone` (one id column)."""
    ids = gone.toDF("_gone").distinct()
    return {name: df.join(ids, df[key] == ids["_gone"], "left_anti") for name, (df, key) in tables.items()}


def keep_largest(df: DataFrame, keys: list[str], size: str, tie: str) -> DataFrame:
    """The row of greatest size of each key, the smallest `tie` among equals."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(size), -F.col(tie))).alias("_v"), F.count(F.lit(1)).alias("copies"))
    return best.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in cols), "copies")


def tree_paths(nodes: DataFrame, node: str, parent: str, title: str, max_depth: int = 1000) -> DataFrame:
    """(node, depth, path) of a forest; nodes whose parent is absent are roots. Cycles and what hangs below them never appear.

    Pointers to ancestors double in every round, so a tree of depth d takes log2(d) joins. Raises if there are more
    than `max_depth` levels.
    """
    ids = nodes.select(F.col(node).alias("_p")).distinct()
    rows = cut(nodes.join(ids, F.col(parent) == F.col("_p"), "left").select(node, F.col("_p").alias("_up"), F.col(title).alias("path"), F.when(F.col("_p").isNull(), 0).otherwise(1).alias("depth")))
    left = None
    while (n := rows.where("_up IS NOT NULL").count()) and n != left:
        left = n
        above = rows.select(F.col(node).alias("_n"), F.col("_up").alias("_up2"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        joined = rows.join(above, F.col("_up") == F.col("_n"), "left")
        rows = cut(joined.select(node, F.col("_up2").alias("_up"), F.when(F.col("_n").isNull(), F.col("path")).otherwise(F.concat("_path", F.lit("/"), "path")).alias("path"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
    rows = rows.where("_up IS NULL").select(node, "depth", "path")
    if not rows.where(F.col("depth") >= max_depth).isEmpty():
        raise ValueError(f"the tree has more than {max_depth} levels")
    return rows


def parents_first(nodes: DataFrame, node: str, parent: str, ordinal: str) -> DataFrame:
    """`nodes` with their `depth` and `place`, an order in which each comes after its parent: by depth, then ordinal."""
    depths = tree_paths(nodes.withColumn("_t", F.col(node).cast("string")), node, parent, "_t", max_depth=1000).select(node, "depth")
    out = nodes.join(depths, node)
    per = out.groupBy("depth").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select(F.col("depth").alias("_d"), "_n")
    base = per.select("depth").join(before, F.col("_d") < F.col("depth"), "left").groupBy("depth").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_base"))  # a row for each level
    w = Window.partitionBy("depth").orderBy(ordinal, node)
    return out.join(F.broadcast(base), "depth").withColumn("place", F.col("_base") + F.row_number().over(w) - 1).drop("_base")


def without_prefix(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose column begins with none of the prefixes, taken as they are (`%` and `_` are no wildcards)."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(F.col(column), F.lit(p))
    return df.where(~F.coalesce(hit, F.lit(False)))


def merged_maps(old: Column, new: Column) -> Column:
    """Entries of both maps; those of `new` win, and those that are null there go."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, F.map_filter(new, lambda k, v: v.isNotNull())))


def sample(df: DataFrame, group: list[str], key: str, seed: int, count: int) -> DataFrame:
    """`count` rows of each group in the order of a seeded hash (all if fewer): repeatable on any partitioning."""
    w = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def rolled_up(groups: DataFrame, members: DataFrame, key: str, member_key: str, count: str, sums: list[str]) -> DataFrame:
    """`groups` with the number of their members (`count`) and sums over these; 0 for none. Members are summed before the join."""
    own = members.groupBy(F.col(member_key).alias(key)).agg(F.count(F.lit(1)).alias(count), *(F.sum(c).alias(c) for c in sums))
    return groups.join(own, key, "left").na.fill(0, [count, *sums])


def run_statistics(blocks: DataFrame, longest: int) -> DataFrame:
    """One row: documents, pages, blocks, blocks of one character, of more than `longest`, characters."""
    pages = blocks.groupBy("document", "page").agg(F.count(F.lit(1)).alias("b"), F.count_if(F.length("text") == 1).alias("o"), F.count_if(F.length("text") > longest).alias("l"), F.sum(F.length("text")).alias("c"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return pages.agg(F.count_distinct("document").alias("documents"), F.count(F.lit(1)).alias("pages"), zero("b").alias("blocks"), zero("o").alias("one_char"), zero("l").alias("needs_rechunk"), zero("c").alias("chars"))


def united(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """(keys, members): what any of the arrays of a key's rows holds, once, in order."""
    return df.select(*keys, F.explode(F.array_distinct(F.concat(*arrays))).alias("_m")).groupBy(*keys).agg(F.array_sort(F.collect_set("_m")).alias("members"))


def with_lookup_keys(df: DataFrame, column: str, fold) -> DataFrame:
    """`df` whose struct `column` has, beside name and subtitle, their folded forms; null where these are blank."""
    out = F.col(column)
    for field in ("name", "subtitle"):
        value = F.col(f"{column}.{field}")
        out = out.withField(f"_lookup_{field}", F.when(F.trim(value) != "", fold(value)))
    return df.withColumn(column, out)


def nested(parents: DataFrame, children: DataFrame, key: str, out: str) -> DataFrame:
    """`parents` with their children's rows as an ordered array of structs; an empty one for none."""
    rest = [c for c in children.columns if c != key]
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(out))
    return parents.join(grouped, key, "left").withColumn(out, F.coalesce(out, F.array().cast(grouped.schema[out].dataType)))
