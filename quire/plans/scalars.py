"""Queries of text, geometry and stat-block functions, over texts built by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import statblocks
from quire.plans.catalogue import query
from quire.sources.tables import spread, table

NL = "\n"
#: A customer's lines with icons, controls, wide spaces, lone W, name lines.
GLYPHS = f"concat(' ', c_name, ' ', CAST(c_nationkey AS VARCHAR(20)), '{NL}', CASE WHEN c_custkey % 3 = 0 THEN 'W' WHEN c_custkey % 3 = 1 THEN concat('W  ', c_mktsegment) ELSE ' \u0085 \x07' END, '{NL}{NL}', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(c_mktsegment, ' Åàé 2d6') END)"


@query(rf"""WITH t AS (SELECT c_custkey, {GLYPHS} AS t FROM customer), l AS (SELECT *, list_filter(list_transform(list_transform(string_split(replace(replace(t, chr(160), ' '), chr(8239), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[\x{{E000}}-\x{{F8FF}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'))), lambda x: regexp_replace(x, '^W\s+(\S)', '\1')), lambda x: x <> '' AND x <> 'W') AS l FROM t)
 SELECT c_custkey, array_to_string(l, chr(10)) AS stripped, TRUE AS icons, replace(replace(t, 'Åàé', '· DM'), chr(10), '/') AS repaired, regexp_replace(regexp_replace(t, '[\p{{Cf}}\p{{Co}}]', '', 'g'), '^\s+|\s+$', '', 'g') AS unformatted FROM l""")
def strip_glyph_texts(spark, d):
    t = F.expr(GLYPHS)
    return table(spark, d, "customer").select("c_custkey", T.strip_layout_glyphs(t).alias("stripped"), T.has_icons(t).alias("icons"), F.replace(T.repair_attack_separator(t), F.lit(NL), F.lit("/")).alias("repaired"), T.strip_format(t).alias("unformatted"))


TITLES = f"concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END, '{NL}', upper(p_type), ' l’')"


@query(rf"""WITH t AS (SELECT p_partkey, {TITLES} AS t FROM part)
 SELECT p_partkey, CASE WHEN upper(t) = t THEN regexp_replace(t, '\s+', ' ', 'g') ELSE t END AS title, replace(t, '’', '''') AS apostrophes, regexp_replace(t, '[^\w.\-\x{{2019}}]', '_', 'g') AS filename FROM (SELECT p_partkey, replace(t, 'l’', 'l’') AS t FROM t)""")
def section_titles(spark, d):
    t = F.expr(TITLES)
    return table(spark, d, "part").select("p_partkey", T.section_title(t).alias("title"), T.fold_apostrophes(t).alias("apostrophes"), F.regexp_replace(t, r"[^\w.\-\x{2019}]", "_").alias("filename"))


URLS = "concat(p_name, ' #', CAST(p_partkey AS VARCHAR(20)), '/+é.PDF')"


@query(f"""SELECT p_partkey, url_encode({URLS}) AS encoded, {URLS} AS decoded, left(regexp_replace(regexp_replace(strip_accents(lower(left({URLS}, length({URLS}) - 4))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS slug FROM part""")
def url_names(spark, d):
    t = F.expr(URLS)
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", T.url_name(t).alias("encoded"), T.from_url_name(T.url_name(t)).alias("decoded"), T.slug_from_filename(t).alias("slug"))


LEAKED = f"concat('Le corps du texte.', '{NL}', upper(p_brand), '{NL}', 'LE ', p_size, '{NL}', p_name, '{NL}', 'Fin')"


@query(f"SELECT p_partkey, concat('Le corps du texte.', '{NL}', 'LE ', p_size, '{NL}', p_name, '{NL}', 'Fin') AS body FROM part")
def leaked_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", T.drop_leaked_titles(F.expr(LEAKED)).alias("body"))


@query(r"SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'tous droits') AS marked, CASE WHEN contains(lower(text), 'secret') THEN 'secret' WHEN contains(lower(text), 'gm only') THEN 'gm only' WHEN contains(lower(text), 'gm-only') THEN 'gm-only' WHEN contains(lower(text), 'hidden truth') THEN 'hidden truth' WHEN contains(lower(text), 'behind the scenes') THEN 'behind the scenes' WHEN contains(lower(text), 'actually') THEN 'actually' WHEN contains(lower(text), 'in truth') THEN 'in truth' WHEN contains(lower(text), 'cult leader') THEN 'cult leader' WHEN contains(lower(text), 'true identity') THEN 'true identity' WHEN regexp_matches(lower(text), '\bthe truth is\b') THEN 'the truth is' END AS leak FROM documents")
def gm_only_leaks(spark, d):
    from quire.operators import semantic

    return table(spark, d, "documents").select("doc_id", T.contains_any(F.col("text"), ("license", "tous droits")).alias("marked"), semantic.spoiler_hit(F.col("text")).alias("leak"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS flat FROM events")
def json_flatten_text(spark, d):
    return table(spark, d, "events").select("event_id", T.flatten_json("props").alias("flat"))


NESTED = 'concat(\'{"a": [\', CAST(p_size AS VARCHAR(20)), \', {"b": "\', p_type, \'"}], "c": null, "d": {"e": ["\', p_brand, \'", true]}}\')'


@query("SELECT p_partkey, concat(p_size, ' ', p_type, '  ', p_brand, ' True') AS flat FROM part")
def json_flatten_nested(spark, d):
    return table(spark, d, "part").select("p_partkey", T.flatten_json(F.expr(NESTED)).alias("flat"))


CHALLENGES = "CASE WHEN p_partkey % 3 = 0 THEN concat('1/', CAST(p_size AS VARCHAR(20))) WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR(20)) END"


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_size END AS number, CASE WHEN p_partkey % 3 = 0 THEN concat('1/', p_size) END AS text FROM part")
def challenge_values(spark, d):
    return table(spark, d, "part").select("p_partkey", T.nc_value(F.expr(CHALLENGES)).alias("v")).select("p_partkey", "v.number", "v.text")


# stat blocks: a text for each part, in either case, with an icon
HEADS = f"concat('\ue000', CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END, CASE WHEN p_partkey % 3 = 0 THEN concat(', ', p_name) ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN concat(' | nc 1/', p_size) ELSE concat(' | NC ', p_size) END, '{NL}agi +', p_size % 7, ' FOR - ', p_size % 5, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(' Int +', p_size % 3, ' AGI -9') END, '{NL}Défense ', p_size + 10, ' pv ', p_size, ' Initiative ', p_size + 1, ' PM ', p_size % 4, '{NL}Griffes +', p_size, ' · DM 1d6+', p_size % 4, '{NL}Épée longue +2 2d8')"


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END END AS name, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN p_name END AS subtitle, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN concat('1/', p_size) ELSE p_size::VARCHAR END AS nc_raw, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_size END AS nc, p_partkey % 5 <> 0 AS challenge FROM part")
def stat_headers(spark, d):
    both = T.once(T.strip_layout_glyphs(F.expr(HEADS)), lambda t: F.struct(statblocks.header(t).alias("h"), statblocks.has_challenge(t, stripped=True).alias("challenge")))
    p = spread(table(spark, d, "part").select("p_partkey", "p_type", "p_name", "p_size"))
    return p.select("p_partkey", both.alias("b")).select("p_partkey", "b.h.*", "b.challenge")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size % 7 ELSE -9 END AS agi, -(p_size % 5) AS \"for\", CASE WHEN p_partkey % 4 <> 0 THEN p_size % 3 END AS int, p_size + 10 AS defense, p_size AS vigor, p_size + 1 AS initiative, p_size % 4 AS mana, concat('Griffes|', p_size, '|1d6+', p_size % 4, ';Épée longue|2|2d8') AS attacks FROM part")
def stat_attributes(spark, d):
    t = F.expr(HEADS)
    p = table(spark, d, "part").select("p_partkey", statblocks.attributes(t).alias("m"), statblocks.combat(t).alias("c"), statblocks.attacks(t).alias("a"))
    attacks = F.array_join(F.transform("a", lambda x: F.concat_ws("|", x["name"], x["attack_bonus"].cast("string"), x["damage"])), ";")
    return p.select("p_partkey", *(F.try_element_at("m", F.lit(k.upper())).alias(k) for k in ("agi", "for", "int")), "c.defense", "c.vigor", "c.initiative", "c.mana", attacks.alias("attacks"))


ABILITIES = f"concat(CASE p_partkey % 5 WHEN 0 THEN 'VOIE DU GEL (L)' WHEN 1 THEN 'L’ŒIL' WHEN 2 THEN 'ÉLAN VITAL' WHEN 3 THEN 'DEF' ELSE 'Souffle' END, ' : ', p_name, '{NL}  suite ', p_size)"


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'VOIE DU GEL' WHEN 2 THEN 'ÉLAN VITAL' END AS title, CASE WHEN p_partkey % 5 IN (0, 2) THEN concat(p_name, '{NL}suite ', p_size) END AS text, p_partkey % 5 NOT IN (1, 4) AS block FROM part")
def ability_blocks(spark, d):
    t = F.expr(ABILITIES)
    p = table(spark, d, "part").select("p_partkey", statblocks.ability(t).alias("a"), statblocks.is_ability_block(t, F.lit(False)).alias("block"))
    return p.select("p_partkey", "a.title", "a.text", "block")


INLINE = "concat('PERDU : avant (I) Init. 12 FROID (L) : ', p_name, '. d’OMBRE : non. NC : 3. ÉLAN : ', CAST(p_size AS VARCHAR(20)))"


@query("SELECT p_partkey, concat('FROID=', p_name, '. d’OMBRE : non.;ÉLAN=', p_size) AS abilities FROM part")
def inline_abilities(spark, d):
    found = statblocks.inline_abilities(F.expr(INLINE))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["title"], x["text"])), ";").alias("abilities"))


HINTS = f"concat(CASE WHEN p_partkey % 4 = 0 THEN 'Morsure +3 · DM 1d6{NL}' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN 'Au premier round de combat. ' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'La lumière du soleil donne un dé malus. Au premier Round de Combat ' ELSE '' END, p_name)"


@query("SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 4 = 0 THEN 'Morsure +3' END, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'EMBUSCADE' END, CASE WHEN p_partkey % 3 = 0 THEN 'SENSIBLE À LA LUMIÈRE' END) AS titles FROM part")
def ability_hints(spark, d):
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", F.array_join(statblocks.hinted_abilities(F.expr(HINTS)), ";").alias("titles"))


@query("SELECT p_partkey, concat_ws(';', p_type, CASE WHEN p_partkey % 2 = 0 THEN p_brand END, 'ÉLAN') AS kept FROM part")
def ability_filter(spark, d):
    titles = F.array(F.lit("PJ"), F.col("p_type"), F.lit("AB"), F.col("p_brand"), F.col("p_type"), F.lit("DEF 12"), F.lit("Griffes +3 1d6"), F.lit("ÉLAN"), F.lit("agi +2"))
    attacks = F.when(F.col("p_partkey") % 2 == 1, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", F.array_join(statblocks.valid_abilities(titles, attacks), ";").alias("kept"))


REFERENCES = f"concat('x ', CASE p_partkey % 4 WHEN 0 THEN concat('Voir le{NL}profil de ', p_type, ' (COF)') WHEN 1 THEN concat('voir le profil de ', p_type, ' (Livre de règles, COF)') WHEN 2 THEN concat('Utilisez le profil du ', p_brand, ' que vous trouverez dans le livre de règles de COF') ELSE 'Voir le profil' END, ' y')"


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN p_type WHEN p_partkey % 4 = 2 THEN p_brand END AS profile FROM part")
def rulebook_references(spark, d):
    return table(spark, d, "part").select("p_partkey", statblocks.rulebook_reference(F.expr(REFERENCES)).alias("profile"))


LABELS = "CASE p_partkey % 4 WHEN 0 THEN ' mort-vivant ' WHEN 1 THEN concat('AGI +1 for -', CAST(p_size AS VARCHAR(20))) WHEN 2 THEN 'AGI +1' ELSE p_name END"


@query("SELECT p_partkey, p_partkey % 4 = 1 AS stats_line, p_partkey % 4 = 0 AS type_label FROM part")
def stat_predicates(spark, d):
    t = F.expr(LABELS)
    return table(spark, d, "part").select("p_partkey", statblocks.is_stats_line(t).alias("stats_line"), statblocks.is_type_label(t).alias("type_label"))


@query("SELECT p_brand, bool_or(p_partkey % 4 = 1) AND bool_or(p_partkey % 11 = 0) AS stats FROM part GROUP BY 1")
def profile_detection(spark, d):
    p = table(spark, d, "part").select("p_brand", F.expr(f"concat(CASE WHEN p_partkey % 11 = 0 THEN 'Garde | NC 2 ' ELSE '' END, {LABELS})").alias("text"))
    return statblocks.is_document_of_stats(p, ["p_brand"])
