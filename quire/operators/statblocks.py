"""Extraction of structured blocks by pattern, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: The letters of titles, attributes, patterns of stat blocks; fixed values.
CAPITALS = "A-ZÀÂÄÉÈÊËÏÎÔÙÛÜŸÇ"
ATTRIBUTES = ("AGI", "FOR", "CON", "INT", "PER", "CHA", "VOL")
HEADER = r"(?im)^(.+?)\s*\|\s*NC\s*(\d+(?:/\d+)?)\s*$"
STATS = rf"(?i)\b({'|'.join(ATTRIBUTES)})\s*([+-])\s*(\d+)"
STATS_START = rf"(?i)^({'|'.join(ATTRIBUTES)})\s*[+-]?\s*\d"
CHALLENGE = r"(?i)(?:\|\s*)?NC\s*(\d+(?:/\d+)?)"
ATTACK = r"(?i)([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\-']+?)\s*\+(\d+)\s*(?:[·\s]|·\s*DM\s*)*(\d+d\d+(?:[+-]\d+)?)"
ABILITY = rf"^([{CAPITALS}][{CAPITALS}0-9\s\-'\u2019]+?)\s*(?:\([A-Z]\))?\s*:\s*(.*)$"
INLINE_ABILITY = rf"(?<![A-Za-zÀ-ÿ])(?<![DdLl]['\u2019])([{CAPITALS}][{CAPITALS}0-9\s\-'\u2019]+?)\s*(?:\([A-Z]\))?\s*:\s*"
NO_ABILITY = r"(?i)\b(AGI|FOR|CON|INT|PER|CHA)\s*[+-]|\b(DEF|PV|NC|TAILLE|CRÉATURE|HUMAINE|HUMAIN)\b"
ATTACK_LINE = r"(?i)^(Morsure|Griffes|.+ \+\d+|.+ · DM)"
ABILITY_HINT = r"(?i)\b(DM\b|round de combat|premier round|surprise|d20|Lorsque la créature réussit)"
BODY = r"(?i)\b(DEF|PV|Init|PM)\b|Voie de|Voir le profil|Utilisez le profil"
CAPITAL_NAME = rf"^[{CAPITALS}][{CAPITALS}0-9\s\-,'\.]{{1,58}}$"
TYPE_LABELS = ("HUMAINE", "HUMAIN", "MORT-VIVANT", "MORT-VIVANTS", "MORT VIVANT", "ANIMAUX", "ANIMAL", "CONSTRUCT", "ESPRIT")
PROFILES = (r"(?i)Voir le profil de (.+?) \((?:Livre de règles, )?COF\)", r"(?i)Utilisez le profil du?\s+(.+?)\s+que vous trouverez dans le livre de règles de COF")
#: What an ability's body says, and the ability's title; fixed values.
BODY_HINTS = (
    (r"(?i)Au premier round de combat", "EMBUSCADE"),
    (r"(?i)premier round de combat", "EMBUSCADE"),
    (r"(?i)cible doit faire un test de PER difficulté 19", "EMBUSCADE"),
    (r"(?i)Lorsque la créature réussit une attaque", "DÉVORER"),
    (r"(?i)un résultat de 15-20 au d20", "DÉVORER"),
    (r"(?is)Créatures souterraines.+dé malus", "SENSIBLE À LA LUMIÈRE"),
    (r"(?is)lumière du soleil.*dé malus", "SENSIBLE À LA LUMIÈRE"),
    (r"(?is)15-20 sur le d20", "COUP CRITIQUE"),
)


def header(t: Column) -> Column:
    """name, subtitle (after the name's first comma), nc_raw, nc of the first header line, whatever its case; null fields where there is none."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    parts = T.once(t, lambda x: F.array(*(F.trim(F.regexp_extract(x, HEADER, i)) for i in (1, 2))))

    def fields(p: Column) -> Column:
        name, raw = (F.nullif(p[i], F.lit("")) for i in (0, 1))
        piece = lambda at: filled(F.regexp_extract(name, at, 1))
        return F.struct(piece("^([^,]*)").alias("name"), piece("^[^,]*,(.*)$").alias("subtitle"), raw.alias("nc_raw"), T.nc_value(raw)["number"].alias("nc"))

    return T.once(parts, fields)


def attributes(t: Column) -> Column:
    """Signed attributes; the last mention of each wins."""
    names, signs, values = (F.regexp_extract_all(t, F.lit(STATS), F.lit(i)) for i in (1, 2, 3))
    pairs = F.arrays_zip(names.alias("k"), signs.alias("s"), values.alias("v"))
    entries = F.transform(pairs, lambda p: F.struct(F.upper(p["k"]).alias("key"), (F.when(p["s"] == "-", -1).otherwise(1) * p["v"].cast("int")).alias("value")))
    last = F.aggregate(entries, F.array().cast("array<struct<key:string,value:int>>"), lambda a, e: F.concat(F.filter(a, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def combat(t: Column) -> Column:
    one = lambda p: F.regexp_extract(t, p, 1).try_cast("int")
    return F.struct(
        one(r"(?i)(?:\(S\)\s*)?(?:Défense|DEF)\s*(\d+)").alias("defense"), one(r"(?i)(?:\(V\)\s*)?(?:Points de vigueur|PV)\s*(\d+)").alias("vigor"),
        one(r"(?i)(?:\(I\)\s*)?(?:Initiative|Init\.?)\s*(\d+)").alias("initiative"), one(r"(?i)(?:\(M\)\s*)?PM\s*(\d+)").alias("mana"),
    )


def attacks(t: Column) -> Column:
    names, bonus, damage = (F.regexp_extract_all(t, F.lit(ATTACK), F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(names.alias("n"), bonus.alias("b"), damage.alias("d")), lambda p: F.struct(F.trim(p["n"]).alias("name"), p["b"].cast("int").alias("attack_bonus"), p["d"].alias("damage")))


def ability(t: Column) -> Column:
    """(title, text) of an ability's block: a title in capitals before a colon on its first line; null for none."""

    def block(lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        title = T.fold_apostrophes(F.regexp_extract(first, ABILITY, 1))
        body = F.filter(F.concat(F.array(F.trim(F.regexp_extract(first, ABILITY, 2))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), lambda x: x != "")
        return F.when(first.rlike(ABILITY) & (title != "") & ~title.rlike(NO_ABILITY), F.struct(title.alias("title"), F.array_join(body, "\n").alias("text")))

    return T.once(F.filter(F.transform(F.split(T.strip_layout_glyphs(t), "\n"), T.strip), lambda x: x != ""), block)


def inline_abilities(t: Column) -> Column:
    """(title, text) of all abilities within a text, in order; after `(I) Init.` where that occurs."""

    def all_of(body: Column) -> Column:
        titles = F.regexp_extract_all(body, F.lit(INLINE_ABILITY), F.lit(1))
        texts = T.once(F.split(body, INLINE_ABILITY), lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))))
        found = F.transform(F.arrays_zip(titles.alias("t"), texts.alias("b")), lambda x: F.struct(T.fold_apostrophes(x["t"]).alias("title"), T.strip(x["b"]).alias("text")))
        return F.filter(found, lambda x: (x["title"] != "") & ~x["title"].rlike(NO_ABILITY))

    body = lambda x: F.when(x.rlike(r"\(I\)\s*Init\."), F.regexp_replace(x, r"(?s)^.*?\(I\)\s*Init\.", "")).otherwise(x)
    return T.once(T.once(T.strip_layout_glyphs(t), body), all_of)


def hinted_abilities(t: Column) -> Column:
    """Titles that a text's wording gives away, each once: of its attack line, then of what its body says."""

    def titles(text: Column) -> Column:
        first = F.trim(F.get(F.split(text, "\n"), F.lit(0)))
        attack = T.once(first, lambda x: F.when(x.rlike(ATTACK_LINE), F.trim(F.get(F.split(x, "·"), F.lit(0)))))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(attack, *(F.when(text.rlike(p), title) for p, title in BODY_HINTS)))))

    return T.once(T.strip_layout_glyphs(t), titles)


def valid_abilities(titles: Column, attack_names: Column) -> Column:
    """Titles of abilities that are none of an attack, a stat or too short, each once, in order."""
    ok = lambda x: (F.length(F.trim(x)) > 2) & (F.trim(x) != "PJ") & ~F.trim(x).rlike(NO_ABILITY) & ~F.array_contains(attack_names, x) & ~x.rlike(ATTACK)
    return F.array_distinct(F.filter(titles, ok))


def rulebook_reference(t: Column) -> Column:
    """The profile of the rule book that a text refers to; null for none."""
    flat = F.regexp_replace(T.strip_layout_glyphs(t), r"\s+", " ")
    return T.once(flat, lambda x: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(x, p, 1)), F.lit("")) for p in PROFILES)))


def has_challenge(t: Column, stripped: bool = False) -> Column:
    return (t if stripped else T.strip_layout_glyphs(t)).rlike(CHALLENGE)


def is_type_label(t: Column) -> Column:
    return F.upper(T.strip(t)).isin(*TYPE_LABELS)


def is_ability_block(t: Column, bold: Column) -> Column:
    def judged(text: Column) -> Column:
        first = F.get(F.split(text, "\n"), F.lit(0))
        named = F.contains(text, F.lit(":")) & (first.rlike(ABILITY) | (bold & first.rlike(r":\s*$")))
        return (text != "") & ~is_stats_line(text) & ~text.rlike(CHALLENGE) & (first.rlike(ATTACK_LINE) | (text.rlike(ABILITY_HINT) & bold) | named)

    return T.once(T.strip_layout_glyphs(t), judged)


def is_document_of_stats(blocks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, stats): whether a document has both a challenge and a line of attributes."""
    return blocks.groupBy(*keys).agg((F.bool_or(has_challenge(F.col(text))) & F.bool_or(is_stats_line(T.strip_layout_glyphs(F.col(text))))).alias("stats"))


def is_stats_line(t: Column) -> Column:
    return F.size(F.regexp_extract_all(t, F.lit(STATS), F.lit(0))) >= 2


def type_hint(t: Column) -> Column:
    low = F.lower(t)
    return (
        F.when(low.rlike(r"armor class|hit points|\bac\s*\d+|\bhp\s*\d+"), "stat_block").when(t.rlike(r"\|[^|\n]+\|"), "stat_block").when(low.contains("secret") | low.contains("gm only"), "secret")
        .when(low.contains("clue"), "clue").when(low.contains("handout"), "handout").when(F.substring(low, 1, 200).contains("map"), "map").otherwise("lore")
    )
