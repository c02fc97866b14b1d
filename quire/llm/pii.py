"""Personal data replaced by keyed surrogates (native: DataFrame expressions only).

Entities are found by one pattern. A surrogate is a function of a key, the entity's type and its
normal form (digits of a number, lower case of an address), so that all mentions of one entity, in
whatever notation, change alike everywhere. It keeps the notation: digits stay digits, letters stay
letters of the same case and script, separators stay, octets stay octets, a domain is one domain in all its
addresses, a family name one family name with and without a given name, which has the title's gender and the
name's script. The key is a session setting.

Distinctness is checked over the whole input: entities whose surrogates meet, or whose surrogate is an
entity that occurs, move to their next attempt until nothing meets. From attempt `WIDE` on, the surrogate
may leave its narrow form (octets of any length, longer local parts, names, keys and secrets), for forms
with fewer surrogates than entities. Then the texts with entities are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, read_table

#: The session setting with the secret key, and the key of tests and samples, where it is unset.
KEY_SETTING = "spark.quire.surrogate.key"
KEY = "surrogate"
#: The attempt from which surrogates take a wider form, and the rounds after which to give up.
WIDE = 12
ROUNDS = 200
LONG = 512
#: Titles and given names by gender and script; fixed values.
TITLES = {"f": "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|г-жа", "m": "Mr|Herr|Monsieur|Señor|Sr|г-н"}
GIVEN = {
    ("f", "latin"): "Ada Bea Cora Dana Edda Fay Gina Hilda Ines Jana Kira Lena Mara Nora Olga Petra",
    ("m", "latin"): "Abel Bruno Carl Denis Emil Frank Georg Hugo Ivo Jonas Karl Louis Max Nils Oskar Paul",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Жанна Зоя Ирина Лидия",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Лев",
}
SYLLABLES = {"latin": "ba be bo da de do ga ge go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va vo", "cyrillic": "ба бе бо да де до га ге го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва во"}

ENTITY = "|".join([
    r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-](?:[A-Za-z0-9.-]{0,251}[A-Za-z0-9-])?(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9-])",
    r"(?i:\b(?:password|passwd|token|secret|api[_-]?key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+[\"']?",
    r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9-]{10,}+)",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    rf"(?<![\p{{L}}])(?:{TITLES['f']}|{TITLES['m']})\.? \p{{Lu}}\p{{Ll}}{{1,30}}+(?: \p{{Lu}}\p{{Ll}}{{1,30}}+)?",
])
#: What every entity has: texts without are passed by cheaply.
HINT = r"[0-9@]|[=:]\s{0,3}[\"']?[A-Za-z+/_-]{8}|AKIA|ghp_|sk-|xox[bp]-|[MFHSг][\p{L}-]{1,8}\.? \p{Lu}"
SECRET_HEAD = r"^((?i:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def kind(e: Column) -> Column:
    """The type of an entity."""
    return (
        F.when(e.rlike(SECRET_HEAD), "secret").when(e.contains("@"), "email").when(e.rlike(rf"^(?:{TITLES['f']})\.? "), "name_f").when(e.rlike(rf"^(?:{TITLES['m']})\.? "), "name_m")
        .when(e.rlike("^(?:AKIA|ghp_|sk-|xox)"), "key").when(e.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(e.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip").when(e.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(e.startswith("+") | (F.length(F.regexp_replace(e, "[^0-9]", "")) < 13), "phone").otherwise("card")
    )


def _value(e: Column, k: Column) -> Column:
    """The part of an entity that is replaced: a secret without its name, a name without its title."""
    return F.when(k == "secret", F.regexp_replace(e, SECRET_HEAD, "")).when(k.startswith("name"), F.regexp_replace(e, r"^[^ ]+ ", "")).otherwise(e)


def normal(e: Column, k: Column) -> Column:
    """The form that all mentions of an entity share."""
    return F.when(k.isin("phone", "card", "ssn"), F.regexp_replace(e, "[^0-9]", "")).when(k == "secret", F.regexp_replace(_value(e, k), "[\"']", "")).when(k.isin("key", "iban"), F.replace(e, F.lit(" "), F.lit(""))).otherwise(F.lower(_value(e, k)))


def _number(seed: Column, i: Column | int, below: int) -> Column:
    """A keyed number from 0 to `below` - 1 for place `i`."""
    place = i if isinstance(i, Column) else F.lit(i)
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(seed, F.lit("/"), place.cast("string")), 256), 1, 12), 16, 10).cast("long"), F.lit(below)).cast("int")


def _letters(base: Column, seed: Column) -> Column:
    """`base` with each digit, small and capital letter replaced within its class; a number's first digit stays non-zero."""
    chars = F.split(base, "")

    def one(c: Column, i: Column) -> Column:
        # the letter's number among letters and digits, so that separators do not matter; of a long secret its place
        at = F.when(F.octet_length(base) > LONG, i).otherwise(F.length(F.regexp_replace(F.substring(base, F.lit(1), F.when(F.octet_length(base) > LONG, 0).otherwise(i)), "[^A-Za-z0-9]", "")))
        n, code = _number(seed, at, 1 << 30), F.ascii(c)
        small = F.when(code < 97, code + 32).otherwise(code)
        letter = F.when(small < 103, F.lit(97) + F.pmod(n, F.lit(6))).otherwise(F.lit(103) + F.pmod(n, F.lit(20)))
        digit = F.when(at == 0, F.when(code == 48, F.lit(48)).otherwise(F.lit(49) + F.pmod(n, F.lit(9)))).otherwise(F.lit(48) + F.pmod(n, F.lit(10)))
        return F.when(code.between(48, 57), F.char(digit)).when(code.between(65, 90), F.char(letter - 32)).when(code.between(97, 122), F.char(letter)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _pick(words: str, seed: Column, i: int) -> Column:
    all_ = words.split()
    return F.element_at(F.array(*map(F.lit, all_)), _number(seed, i, len(all_)) + 1)


def _family(name: Column, seed: Column, wide: Column) -> Column:
    """A family name in the script of `name`."""

    def of(script: str) -> Column:
        return F.initcap(F.concat(*(_pick(SYLLABLES[script], seed, i) for i in range(1, 5)), F.when(wide, F.concat(*(_pick(SYLLABLES[script], seed, i) for i in range(5, 8)))).otherwise("")))

    return F.when(name.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _given(name: Column, seed: Column, gender: str, wide: Column) -> Column:
    """A given name of the gender in the script of `name`; wide: two of them."""

    def of(script: str) -> Column:
        names = GIVEN[gender, script]
        return F.concat(_pick(names, seed, 0), F.when(wide, F.concat(F.lit("-"), _pick(names, seed, 1), F.lit(" "), F.initcap(F.concat(*(_pick(SYLLABLES[script], seed, i) for i in range(2, 5)))))).otherwise(""))

    return F.when(name.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _named(df: DataFrame, e: str, suffix: str = "") -> DataFrame:
    """`df` with the type `k` and the `name` (type and normal form) of the entity in column `e`."""
    k, name = f"k{suffix}", f"name{suffix}"
    df = df.withColumn(k, kind(F.col(e)))
    group = F.when(F.col(k).startswith("name"), F.lit("name")).otherwise(F.col(k))
    return df.withColumn(name, F.concat_ws("|", group, normal(F.col(e), F.col(k))))


def _part(e: Column, k: Column) -> Column:
    """The part of an entity that others may share, with its type: an address's domain without its last label, a name's family name."""
    host, family = F.lower(F.regexp_extract(e, r"@(.*)\.[^.]*$", 1)), F.lower(F.regexp_extract(e, r" ([^ ]+)$", 1))
    return F.when(k == "email", F.concat(F.lit("domain|"), host)).when(k.startswith("name"), F.concat(F.lit("family|"), family))


def _with_parts(df: DataFrame, key: str) -> DataFrame:
    """`df` (part `e` with its type in front, name, attempt) with the part's surrogate `s`."""
    df = df.withColumns({"_seed": F.sha2(F.concat_ws("|", F.lit(key), "name", F.col("attempt").cast("string")), 256), "_body": F.regexp_replace("e", "^[a-z]+[|]", "")})
    wide = F.col("attempt") >= WIDE
    domain = F.concat(_letters(F.col("_body"), F.col("_seed")), F.when(wide, F.substring(F.sha2(F.concat(F.col("_seed"), F.lit("/wide")), 256), 1, 12)).otherwise(""))
    return df.withColumn("s", F.when(F.col("e").startswith("domain|"), F.concat(F.lit("domain|"), domain)).otherwise(F.concat(F.lit("family|"), F.lower(_family(F.col("_body"), F.col("_seed"), wide))))).drop("_seed", "_body")


def with_surrogates(df: DataFrame, key: str = KEY) -> DataFrame:
    """`df` (entity e, type k, name, attempt, surrogate `part` of its part) with the surrogate `s`. Each step is a column, so that none is computed twice."""
    e, k = F.col("e"), F.col("k")
    df = df.withColumns({
        "_seed": F.sha2(F.concat_ws("|", F.lit(key), "name", F.col("attempt").cast("string")), 256), "_value": _value(e, k), "_head": F.regexp_extract(e, SECRET_HEAD, 1), "_title": F.regexp_extract(e, r"^([^ ]+ )", 1),
        "_local": F.regexp_extract(e, "^(.*)@", 1), "_host": F.regexp_extract(e, r"@(.*)\.[^.]*$", 1), "_top": F.regexp_extract(e, r"@.*(\.[^.]*)$", 1),
        # the first mark of a key, of a bank account, of a number stays
        "_mark": F.regexp_extract(e, r"^(AKIA|ghp_|sk-|xox[bp]-|[A-Z]{2}(?=[0-9]{2})|\+[0-9]{1,3}(?=[^0-9]))", 1),
    })
    df = df.withColumns({"_rest": F.expr("substring(e, length(_mark) + 1)"), "_shared": F.regexp_replace("part", "^[a-z]+[|]", "")})
    seed, wide = F.col("_seed"), F.col("attempt") >= WIDE
    octets = F.array_join(F.transform(F.split(e, r"\."), lambda o, i: F.when(wide, _number(seed, i, 255) + 1).when(F.length(o) == 1, _number(seed, i, 9) + 1).when(F.length(o) == 2, _number(seed, i, 90) + 10).otherwise(_number(seed, i, 156) + 100).cast("string")), ".")
    # one pass over letters for whatever part is replaced
    df = df.withColumn("_base", F.when(k == "email", F.col("_local")).when(k == "secret", F.col("_value")).otherwise(F.col("_rest")))
    df = df.withColumn("_swapped", _letters(F.col("_base"), seed))
    # a wide one is longer, within its closing quote
    longer = F.concat(F.regexp_replace("_swapped", "[\"']$", ""), F.substring(F.sha2(F.concat(seed, F.lit("/wide")), 256), 1, 12), F.regexp_extract("_swapped", "[\"']$", 0))
    df = df.withColumn("_swapped", F.when(wide & k.isin("email", "secret", "key"), longer).otherwise(F.col("_swapped")))
    domain = F.when(F.col("_host") == F.upper("_host"), F.upper("_shared")).otherwise(F.col("_shared"))
    # a name with a given name gets one of the title's gender; the family name is that of all its mentions
    named = lambda g: F.concat("_title", F.when(F.col("_value").contains(" "), F.concat(_given(F.col("_value"), seed, g, wide), F.lit(" "))).otherwise(""), F.initcap("_shared"))
    made = (
        F.when(k == "email", F.concat(F.col("_swapped"), F.lit("@"), domain, F.col("_top"))).when(k == "ip", octets).when(k == "secret", F.concat("_head", "_swapped")).when(k == "name_f", named("f"))
        .when(k == "name_m", named("m")).otherwise(F.concat("_mark", "_swapped"))
    )
    return df.withColumn("s", made).select("e", "k", "name", "attempt", "part", "s")


def _settled(table: DataFrame, make: Callable[[DataFrame], DataFrame], name_of: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """`table` (e, name and what `make` needs) with surrogates `s`, whose names (`made`, by `name_of`) are distinct where names are.

    A name keeps its attempt unless its surrogate's name is that of a smaller name's surrogate or of an
    entity that occurs; then it goes on to the next attempt. Raises if names still meet after `rounds`.
    """
    table = cut_lineage(table.withColumn("attempt", F.lit(0)))
    columns = table.columns
    taken = table.select(F.col("name").alias("made")).distinct()
    kept = None
    for _ in range(rounds):
        made = name_of(make(table)).select(*columns, "s", "made")
        made = cut_lineage(made if kept is None else kept.unionByName(made))
        pairs = made.select("made", "name").distinct()
        met = pairs.groupBy("made").agg(F.min("name").alias("_first"), F.count(F.lit(1)).alias("_n"))
        clash = met.where("_n > 1").select("made", "_first").unionByName(met.join(taken, "made", "left_semi").select("made", F.lit(None).cast("string").alias("_first")))
        clash = clash.groupBy("made").agg(F.min(F.coalesce("_first", F.lit(""))).alias("_first"))
        moved = cut_lineage(pairs.join(clash, "made").where("_first <> name").select("name").distinct())
        if moved.isEmpty():
            return made
        kept = made.join(moved, "name", "left_anti")
        table = made.join(moved, "name", "left_semi").select(*(c for c in columns if c != "attempt"), (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError(f"surrogates still meet after {rounds} rounds")


def surrogates(found: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(e, s) for the distinct entities `found` (column e): their surrogates, distinct where the entities' names are.

    Domains and family names, which entities share, are settled first: distinct ones stay distinct, and all
    addresses of a domain, all forms of a name ("Mrs. Jane Roe", "Mrs. Roe") keep them in common.
    """
    named = _named(found.distinct(), "e").withColumn("_part", _part(F.col("e"), F.col("k")))
    parts = named.where("_part IS NOT NULL").select(F.col("_part").alias("e"), F.col("_part").alias("name")).distinct()
    parts = _settled(parts, lambda t: _with_parts(t, key), lambda t: t.withColumn("made", F.lower("s")), rounds)
    table = named.join(parts.select(F.col("e").alias("_part"), F.col("s").alias("part")), "_part", "left").select("e", "k", "name", "part")
    return _settled(table, lambda t: with_surrogates(t, key), lambda t: _named(t, "s", "2").withColumnRenamed("name2", "made"), rounds).select("e", "s")


def replace_entities(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """`docs` with `text` rewritten and n_entities (entities replaced in the row).

    Null texts stay null with 0 entities; empty texts stay empty. All other columns and all rows are
    kept; a column n_entities of the input is replaced. Equal texts, and so tied and repeated rows, are rewritten
    alike; an empty table gives an empty result. Texts of any length are searched whole: no repetition in the
    pattern recurses. Only texts with entities are shuffled, by their hash; texts without stay where they are.
    """
    docs = docs.drop("n_entities")
    body, kept = F.col(text), docs.columns
    hinted = docs.where(body.rlike(HINT)).withColumn("_hash", F.md5(body.cast("binary")))
    marks = cut_lineage(hinted.select("_hash", F.posexplode(entities(body)).alias("_at", "e")).distinct())
    found = surrogates(marks.select("e"), key)
    swaps = marks.join(found, "e").groupBy("_hash").agg(F.array_sort(F.collect_list(F.struct("_at", "s"))).alias("_swaps"))
    made = F.array_join(F.transform(F.arrays_zip(F.split(body, ENTITY, -1).alias("p"), F.col("_swaps.s").alias("s")), lambda x: F.concat(x["p"], F.coalesce(x["s"], F.lit("")))), "")
    hit = hinted.join(swaps, "_hash", "left").withColumn("n_entities", F.coalesce(F.size("_swaps"), F.lit(0)).cast("long"))
    hit = hit.withColumn(text, F.when(F.col("_swaps").isNotNull(), made).otherwise(body)).select(*kept, F.greatest("n_entities", F.lit(0).cast("long")).alias("n_entities"))
    rest = docs.where(body.isNull() | ~body.rlike(HINT)).select(*kept, F.lit(0).cast("long").alias("n_entities"))
    return rest.unionByName(hit)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    key = spark.conf.get(KEY_SETTING, KEY)
    return replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key).select("doc_id", "n_entities", "text")
