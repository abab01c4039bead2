"""The registered query of each operator over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.llm import convolution, language, mixing, toxicity, warc
from costloom.llm.alignment import alignment_scores
from costloom.llm.decontamination import benchmark_matches
from costloom.llm.dialogues import repaired
from costloom.llm.lines import repeated_lines
from costloom.llm.near_duplicates import near_duplicates
from costloom.llm.quality import quality_rules
from costloom.llm.storage import table
from costloom.llm.tokens import context_limits, encoded_lengths
from costloom.llm.url_rules import rules_table, url_verdicts
from costloom.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_verdicts(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_bundles(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "of_id": "of_doc_id"})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    marks = table(spark, sf_dir, "labels").where((F.crc32(F.col("doc_id").cast("string")) % 4) != 2)
    model = toxicity.learn(*toxicity.labelled_sample(docs, marks))
    return toxicity.scored(docs, model, carry=["doc_id", "held_out"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "score", "first_word", "n_words", "passage")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(encoded_lengths(table(spark, sf_dir, "documents"), VOCABULARY))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3) == 1
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = language.learn(docs, "text", "lang", ~F.col("held_out"))
    return language.identified(docs, model, carry=["doc_id", "held_out"]).drop("entropy")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(*base, "base_failed", "distance", "kept")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults that a hash of conversation and turn chooses; nulls are one space."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = turns.withColumn("fault", F.crc32(name) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def op11_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repaired(damaged(turns)).report.withColumnRenamed("id", "conv_id")
    # Conversations of which the damage leaves no row are answered by zeros.
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    zeros = turns.select("conv_id").distinct().select("conv_id", *(nothing.get(c, F.lit(0).cast("long")).alias(c) for c in found.columns[1:]))
    rows = [df.select("conv_id", F.lit(rank).alias("rank"), *found.columns[1:]) for rank, df in ((1, found), (0, zeros))]
    best = rows[0].unionByName(rows[1]).groupBy("conv_id").agg(F.max(F.struct("rank", *found.columns[1:])).alias("r"))
    return best.select("conv_id", *(F.col(f"r.{c}").alias(c) for c in found.columns[1:]))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_scores(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE, carry=["doc_id"])


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5) == 0
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    marks = table(spark, sf_dir, "labels").where((F.crc32(F.col("doc_id").cast("string")) % 5) != 0)
    return convolution.scored(docs, convolution.learn(docs, marks), carry=["doc_id", "held_out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_warc": op2_warc,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_minhash": op7_minhash,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_dialogues": op11_dialogues,
    "op12_alignment": op12_alignment,
    "op13_quality": op13_quality,
}


# Lines that repeat an earlier one. A variant is a line less one word; words hold no space, so joined text names them.
LINE_DEDUP = r"""
with lines as (
    select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as line
    from documents where doc_id is not null
), words as (
    select doc_id, line, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from lines
), full_lines as (
    select doc_id, line, len(w) as size, array_to_string(w, ' ') as t, w, doc_id::hugeint * 1000000000 + line as place
    from words where len(w) > 0
), firsts as (
    select t, any_value(w) as w, any_value(size) as size, min(place) as place from full_lines group by t
), gaps as (
    select place, size, unnest(range(size)) as gap, w from firsts where size >= 8
), variants as (
    select place, size, gap, array_to_string(list_concat(w[:gap], w[gap + 2:]), ' ') as t from gaps
), replaced as (
    select place, min(place) over (partition by size, gap, t) as of from variants
), shorter as (
    select v.place as long, f.place as short from variants v join firsts f on v.t = f.t where f.size >= 8
), near as (
    select place, min(of) as of from (
        select place, of from replaced where of < place
        union all select long, short from shorter where short < long
        union all select short, long from shorter where long < short
    ) group by place
), found as (
    select l.doc_id, l.line, l.size, f.place < l.place as exact,
        least(case when f.place < l.place then f.place end, n.of) as of
    from full_lines l join firsts f on l.t = f.t left join near n on n.place = f.place
)
select doc_id, line, size, case when exact then 'exact' else 'near' end as kind,
    (of // 1000000000)::bigint as of_doc_id, (of % 1000000000)::bigint as of_line
from found where of is not null
"""


# The longest of the rules that fit each url's host and the beginning of its path.
URL_FILTER = r"""
with rests as (
    select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
    select row_number() over () as row, page_id,
        translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
    from rests
), rules(verdict, rule, rule_host, rule_path) as (
    values ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
        ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), best as (
    select row, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
    from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
    group by row
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (row)
"""

# Equal payloads of at least 100 bytes: the page with the least id holds them, pages with larger ids revisit it.
WARC = """
with payloads as (
    select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as bytes from pages
), firsts as (
    select payload, min(page_id) as first from payloads where bytes >= 100 group by payload
)
select page_id, bytes::bigint as payload_bytes, sha256(payload) as payload_digest,
    case when page_id > first then 'revisit' else 'response' end as record_type,
    case when page_id > first then first end as refers_to
from payloads left join firsts using (payload)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC, "op1_url_filter": URL_FILTER, "op3_line_dedup": LINE_DEDUP}
