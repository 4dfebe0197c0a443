"""Text and projection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query, table
from .fixtures import BLOCKS, blocks

_D = "documents"
_RE2_WORD = r"[\p{L}\p{M}\p{N}_]"


@query("X01_normalize_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS text FROM documents""")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", X.normalize_spacing(X.nfkc(F.col("text"))).alias("text"))


@query("X02_normalize_prose")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", X.normalize_prose(F.col("text")).alias("text"))


@query("X03_quality_flags", rf"""SELECT doc_id, concat_ws(',', CASE WHEN contains(text, chr(65533)) THEN 'replacement_character' END, CASE WHEN contains(text, '??') THEN 'unresolved_placeholder' END,
 CASE WHEN regexp_matches(text, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:[A-Za-z]\s){{5,}}[A-Za-z]($|[^\p{{L}}\p{{M}}\p{{N}}_])') THEN 'possible_spaced_ocr_text' END) AS flags FROM documents""")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", F.array_join(X.quality_flags(F.col("text")), ",").alias("flags"))


@query("X04_token_estimate", rf"""SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + (len(regexp_extract_all(text, '[\x{{3400}}-\x{{9fff}}]')) + 1) // 2
 + len(regexp_extract_all(text, '[^\p{{L}}\p{{M}}\p{{N}}_\s\x{{3400}}-\x{{9fff}}]')) // 4) AS tokens FROM documents""")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


_SPACED = r"concat('\frac ', split_part(content, ' ', 1), ' _ {', split_part(content, ' ', 2), '} ^{ - 3 } \alpha  \beta x _ i j \_ k _ {', split_part(content, ' ', 3), '} 1. 5. 7 - 2 a - 4 ', content)"


@query("X06_formula_spacing", rf"""WITH {BLOCKS}, f AS (SELECT doc_id, block_no, trim(regexp_replace({_SPACED}, '[ \t\f\v]+', ' ', 'g')) AS t FROM blocks), a AS (SELECT doc_id, block_no, regexp_replace(t, '(\\[A-Za-z]+)\s+([A-Za-z])', '\1@@\2', 'g') AS t FROM f),
 b AS (SELECT doc_id, block_no, regexp_replace(regexp_replace(t, '([A-Za-z])\s+([A-Za-z])', '\1\2', 'g'), '([A-Za-z])\s+([A-Za-z])', '\1\2', 'g') AS t FROM a), c AS (SELECT doc_id, block_no, regexp_replace(regexp_replace(t, '([A-Za-z])\s+_\s*', '\1_', 'g'), '([A-Za-z])\s+\\_\s*', '\1\\_', 'g') AS t FROM b),
 d AS (SELECT doc_id, block_no, regexp_replace(regexp_replace(t, '_\s+([A-Za-z{{])', '_\1', 'g'), '\\_\s+([A-Za-z])', '\\_\1', 'g') AS t FROM c), e AS (SELECT doc_id, block_no, regexp_replace(regexp_replace(t, '(\d)\.\s+(\d)', '\1.\2', 'g'), '(\d)\.\s+(\d)', '\1.\2', 'g') AS t FROM d)
 SELECT doc_id, block_no, replace(regexp_replace(regexp_replace(t, '([{{^])\s+(-\s*\d)', '\1\2', 'g'), '-\s+(\d)', '-\1', 'g'), '@@', ' ') AS formula FROM e""")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas written with a blank between characters, made around each block."""
    return blocks(spark, sf_dir).select("doc_id", "block_no", X.formula_spacing(F.expr(_SPACED.replace("\\", "\\\\"))).alias("formula"))


@query("X07_html_to_prose")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_prose(F.col("html")).alias("prose"))


@query("X09_matrix_to_markdown", f"""WITH {BLOCKS}, cells AS (SELECT doc_id, block_no, string_split(content, ' | ') AS c FROM blocks WHERE contains(content, ' | '))
 SELECT doc_id, block_no, '| ' || array_to_string(list_transform(c, lambda x: trim(replace(x, '|', chr(92) || '|'))), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(c, lambda x: '---'), ' | ') || ' |' AS markdown FROM cells""")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = blocks(spark, sf_dir).filter(F.col("content").contains(" | ")).withColumn("matrix", F.array(F.split("content", r" \| ")))
    return cells.select("doc_id", "block_no", X.matrix_to_markdown(F.col("matrix")).alias("markdown"))


@query("X13_text_keys", r"SELECT doc_id, md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS spaceless, md5(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}]+', '', 'g'))) AS wordonly FROM documents")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", F.md5(X.compact_key(F.col("text"))).alias("spaceless"), F.md5(X.word_key(F.col("text"))).alias("wordonly"))


@query("X18_question_terms", r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]+'), regexp_extract_all(text, '\d+(?:\.\d+)?%?')))), ' ') AS terms FROM conversations WHERE role = 'user'")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(X.question_terms(F.col("text"))), " ").alias("terms"))


@query("X19_excerpt", "SELECT doc_id, substring(text, greatest(1, (CASE WHEN instr(lower(text), 'license') > 0 THEN instr(lower(text), 'license') ELSE 1 END) - 40), 160) AS excerpt FROM documents")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", X.excerpt(F.col("text"), F.array(F.lit("license")), 160).alias("excerpt"))


@query("X21_numbers", r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(' ' || text || ' ', '[^\p{L}\p{M}\p{N}_.]([0-9]+)[ \n]', 1)) AS x FROM documents)
 SELECT doc_id, count(DISTINCT coalesce(nullif(ltrim(x, '0'), ''), '0')) AS plain FROM n GROUP BY doc_id""")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_extract_all(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), F.lit(r"(?U)[^\p{L}\p{M}\p{N}_.]([0-9]+)[ \n]"), F.lit(1))
    d = table(spark, sf_dir, _D).select("doc_id", F.explode(F.transform(plain, X.canonical_number)).alias("x"))
    return d.groupBy("doc_id").agg(F.count_distinct("x").alias("plain"))


@query("X21_canonical_numbers")
def x21b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", F.array_join(F.array_sort(X.numbers_in(F.col("text"))), " ").alias("numbers"))


@query("X23_title_case", f"WITH {BLOCKS} SELECT doc_id, block_no, bool_and(w = '' OR upper(left(w, 1)) = left(w, 1) OR w IN ('of', 'the', 'and', 'in', 'to', 'a')) AS titled FROM (SELECT doc_id, block_no, unnest(string_split(content, ' ')) AS w FROM blocks) GROUP BY doc_id, block_no")
def x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    minor = ["of", "the", "and", "in", "to", "a"]
    ok = F.forall(F.split("content", " "), lambda w: (w == "") | (F.upper(F.left(w, F.lit(1))) == F.left(w, F.lit(1))) | w.isin(minor))
    return blocks(spark, sf_dir).select("doc_id", "block_no", ok.alias("titled"))


@query("X24_author_sort_key", f"WITH {BLOCKS}, n AS (SELECT doc_id, block_no, CASE WHEN block_no % 3 = 0 THEN replace(content, 'a', '¨a') ELSE content END AS name FROM blocks) SELECT doc_id, block_no, nullif(regexp_replace(lower(strip_accents(replace(replace(name, '¨', '~'), 'ß', 'ss'))), '[^a-z~]', '', 'g'), '') AS key FROM n")
def x24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of whole blocks; every third has its a's printed with a diaeresis that stands alone."""
    name = F.when(F.col("block_no") % 3 == 0, F.replace("content", F.lit("a"), F.lit("¨a"))).otherwise(F.col("content"))
    return blocks(spark, sf_dir).select("doc_id", "block_no", X.sort_key(name).alias("key"))


@query("X25_fingerprint", "SELECT doc_id, sha256(text) AS fingerprint, md5(source || ':' || lang) AS group_key FROM documents")
def x25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.md5(F.concat("source", F.lit(":"), "lang")).alias("group_key"))


@query("X27_rounding", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def x27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("X29_stage_progress", "SELECT event_id, CASE event_type WHEN 'view' THEN 0.05 WHEN 'click' THEN 0.12 WHEN 'purchase' THEN 1.0 ELSE 0.0 END AS progress FROM events")
def x29(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.create_map(*[F.lit(x) for kv in {"view": 0.05, "click": 0.12, "purchase": 1.0}.items() for x in kv])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(stages, F.col("event_type")), F.lit(0.0)).alias("progress"))


_PREVIEW = r"left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[#*_`>|]+', '', 'g'), '\s+', ' ', 'g')), 260)"


@query("X35_markdown_preview", f"SELECT doc_id, {_PREVIEW} AS preview FROM documents")
def x35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _D).select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("X35_linked_previews", f"WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# [' || source || '](http://x/y) ' || text WHEN 1 THEN '![' || source || '](a.png)' || text ELSE text END AS text FROM documents) SELECT doc_id, {_PREVIEW} AS preview FROM m")
def x35_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of texts, a third of which begin with a link and a third with an image."""
    kind = F.col("doc_id") % 3
    linked = F.when(kind == 0, F.concat(F.lit("# ["), "source", F.lit("](http://x/y) "), "text")).when(kind == 1, F.concat(F.lit("!["), "source", F.lit("](a.png)"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, _D).select("doc_id", X.preview(linked).alias("preview"))


@query("F11_spurious_heading", rf"WITH {BLOCKS} SELECT doc_id, block_no FROM blocks WHERE regexp_matches(content, '^(?:\d+\s+){{2,}}\d+$')")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).filter(F.col("content").rlike(r"^(?:\d+\s+){2,}\d+$")).select("doc_id", "block_no")


@query("F12_caption_predicate", rf"WITH {BLOCKS} SELECT doc_id, block_no, len(regexp_extract_all(content, 'https?://')) >= 2 AS url_heavy, regexp_matches(content, '^(Figure|Fig\.|Table)\s*\d+') AS caption FROM blocks")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "block_no", (F.regexp_count("content", F.lit("https?://")) >= 2).alias("url_heavy"), F.col("content").rlike(r"^(Figure|Fig\.|Table)\s*\d+").alias("caption"))


@query("F18_scope_classification", f"WITH {BLOCKS} SELECT doc_id, block_no, CASE WHEN contains(lower(content), 'license') THEN 'legal' WHEN contains(lower(content), 'copyright') THEN 'legal' WHEN contains(content, '@') THEN 'contact' WHEN contains(content, '|') THEN 'table' ELSE 'prose' END AS category FROM blocks")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("content")
    category = F.when(low.contains("license"), "legal").when(low.contains("copyright"), "legal").when(F.col("content").contains("@"), "contact").when(F.col("content").contains("|"), "table").otherwise("prose")
    return blocks(spark, sf_dir).select("doc_id", "block_no", category.alias("category"))


@query("P03_chunk_record", f"WITH {BLOCKS} SELECT doc_id, block_no, sha256(content) AS content_sha256, length(content) AS n_chars, source || ' > ' || lang AS section FROM blocks")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "block_no", F.sha2("content", 256).alias("content_sha256"), F.length("content").cast("long").alias("n_chars"), X.section_label(F.array("source", "lang")).alias("section"))


@query("P03_chunk_ids")
def p03b(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("text"), F.lit("body"), F.sha2("content", 256))
    return blocks(spark, sf_dir).select("doc_id", "block_no", X.uuid5_url(identity).alias("chunk_id"))


@query("P10_content_type", "SELECT event_id, CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'figure' WHEN 'purchase' THEN 'table' ELSE 'text' END AS content_type FROM events")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "figure").when(F.col("event_type") == "purchase", "table").otherwise("text").alias("content_type"))


@query("P13_context_pruning", f"WITH {BLOCKS} SELECT doc_id, block_no, left(content, 240) AS quote, length(content) > 240 AS cut FROM blocks")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", "block_no", F.left("content", F.lit(240)).alias("quote"), (F.length("content") > 240).alias("cut"))


@query("P17_atomic_rules", f"WITH {BLOCKS} SELECT doc_id, block_no, atom_no, trim(atom) AS atom FROM (SELECT doc_id, block_no, unnest(string_split(content, '. ')) AS atom, CAST(generate_subscripts(string_split(content, '. '), 1) AS INTEGER) AS atom_no FROM blocks) WHERE trim(atom) <> ''")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = blocks(spark, sf_dir).select("doc_id", "block_no", F.posexplode(F.split("content", r"\. ")).alias("n", "atom"))
    return atoms.filter(F.trim("atom") != "").select("doc_id", "block_no", (F.col("n") + 1).alias("atom_no"), F.trim("atom").alias("atom"))


@query("K06_index_projection", f"WITH {BLOCKS} SELECT doc_id, block_no, content, source AS section, page, lang FROM blocks WHERE length(content) > 20")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).filter(F.length("content") > 20).select("doc_id", "block_no", "content", F.col("source").alias("section"), "page", "lang")


@query("S06_nested_layout", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref FROM events")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))
