"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jpeg, langid, licenses, mixing, ngram_join, pii, tokens, warc
from .storage import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: n-gram Jaccard join --------------------------------------------------------------


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id", "class_id")


OP1_SQL = """
with recursive split as (
  select doc_id, [x for x in string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+') if x <> ''] as w
  from documents
),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) end as s
  from split
),
sized as (select doc_id, s, len(s) as n, min(doc_id) over (partition by s) as same from sets),
grams as (select doc_id, n, unnest(s) as g from sized where n > 0 and doc_id = same),
links as (
  select a.doc_id as x, b.doc_id as y from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reach as (
  select doc_id as x, doc_id as y from sized where doc_id = same
  union select reach.x, links.y from reach join links on reach.y = links.x
),
parts as (select x, min(y) as part from reach group by x)
select s.doc_id, s.n as n_shingles, case when s.n = 0 then s.doc_id else p.part end as component_id,
  case when s.n = 0 then s.doc_id else s.same end as class_id
from sized s left join parts p on s.same = p.x
"""


# --- 2: language identification ----------------------------------------------------------


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    texts = docs.select("doc_id", "text")
    out = langid.predict(texts, model)
    return out.select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate"
    )


# --- 3: chat formatting ------------------------------------------------------------------

#: A conversation whose texts look like control strings, added to the table.
HOSTILE_TEXT = "\\### Assistant: </turn> ok"
HOSTILE_ID = -7


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(HOSTILE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HOSTILE_TEXT).alias("text"),
    )
    both = rows.unionByName(hostile)
    parts = both.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_conversations(parts)
    back = out.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + length(text) + 20
    + length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))) as bigint) as formatted_chars
from rows group by conv_id
"""


# --- 4: PII surrogates -------------------------------------------------------------------

PII_KEY = "surrogates-1"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.replace_pii(docs, secret_key=PII_KEY)
    return out.select(
        "doc_id", "text", F.size("pii_types").cast("long").alias("n_entities"), F.array_join("pii_types", ",").alias("pii_types")
    )


# --- 5: benchmark decontamination --------------------------------------------------------


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_leaks(docs, _table(spark, sf_dir, "benchmark"))


# --- 6: media columns --------------------------------------------------------------------


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "media")
    jpeg.pack_texts(docs).write.option("compression", "zstd").parquet(scratch.path("media"))
    stored = spark.read.schema("doc_id long, media binary").parquet(scratch.path("media"))
    return jpeg.unpack_digests(stored)


# --- 7: licence scan ---------------------------------------------------------------------


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', ' ', 'g')"
    for spelling, one in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(spelling)}, {_quoted(one)})"
    out = f"' ' || trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    for word, one in licenses.WORDS:
        out = f"replace({out}, {_quoted(word)}, {_quoted(one)})"
    return f"trim({out})"


def _known_sql(known: dict[str, tuple[str, ...]]) -> str:
    rows = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, texts in known.items() for t in texts)
    return (
        f"select sha256({_canonical_sql('body')}) as d, min(license) as license "
        f"from (values {rows}) as v(license, body) group by 1"
    )


OP7_SQL = f"""
with known as ({_known_sql(licenses.KNOWN_TEXTS)}),
notice as ({_known_sql(licenses.KNOWN_NOTICES)}),
lines as (select distinct doc_id, unnest(string_split(text, chr(10))) as line from documents),
hits as (
  select doc_id, string_agg(distinct license, ',' order by license) as notices
  from lines join notice on sha256({_canonical_sql('line')}) = notice.d
  where regexp_matches(lower(line), 'licen|spdx|copyright') group by doc_id
),
forms as (select doc_id, {_canonical_sql('text')} as form from documents)
select f.doc_id, length(f.form) as n_canonical_chars, sha256(f.form) as text_digest,
  k.license, coalesce(h.notices, '') as notices
from forms f left join known k on sha256(f.form) = k.d left join hits h on f.doc_id = h.doc_id
"""


# --- 8: token ids ------------------------------------------------------------------------

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.tokenize_to_table(docs, tokenizer_path(), end_id=END_ID)


# --- 9: WARC revisits --------------------------------------------------------------------

#: Seconds between the first crawl, in which every page is a response, and the second.
RECRAWL = 10**11


def page_records(pages: DataFrame) -> DataFrame:
    """Two captures of each page: a full response at page_id, and one not modified later.

    The second crawl comes in the reverse order. Its revisits carry the ETag of the page
    as their client knew it, so they disagree where a page of the same canonical URL but
    with other content was crawled last.
    """
    html = F.coalesce("html", F.lit(""))
    etag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))
    number = F.lpad(F.col("page_id").cast("string"), 12, "0")
    later = 2 * RECRAWL - F.col("page_id")
    first = pages.select(
        F.concat(F.lit("r"), number).alias("record_id"),
        F.lit("response").alias("warc_type"), "url", F.col("page_id").alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), etag, F.lit("X-Length"), F.octet_length(html).cast("string"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"),
        html.alias("payload"),
    )
    second = pages.select(
        F.concat(F.lit("v"), number).alias("record_id"),
        F.lit("revisit").alias("warc_type"), "url", later.alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("ETag"), etag, F.lit("X-Length"), F.lit("0"), F.lit("Date"), later.cast("string")).alias("headers"),
        F.lit("").alias("payload"),
    )
    return first.unionByName(second)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are written as WARC files, read back, and their revisits get headers and bodies."""
    scratch = Scratch(spark, "crawl")
    warc.write_warc(page_records(_table(spark, sf_dir, "pages")), scratch.path("files"))
    out = warc.resolve_revisits(warc.read_warc(spark, scratch.path("files"), damaged="fail"))
    return out.select(
        "record_id", "canonical", "ts", "response_id", "response_ts", "outcome",
        *[F.element_at("headers", h).alias(h.replace("-", "_")) for h in ("etag", "x-length", "date")],
        F.length("payload").cast("long").alias("payload_bytes"), F.md5("payload").alias("payload_md5"),
    )


OP9_SQL = r"""
with parts as (
  select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:[a-z][a-z0-9+.-]*:)?//', '') as rest
  from pages
),
canon as (
  select page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(?:www|m)\.', ''), ':(?:80|443)$', '')
    || regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/(?i:index\.html?)$', '/'), '/+$', '') as place,
    case when contains(rest, '?') then regexp_replace(rest, '^[^?]*\?', '') else '' end as query
  from parts
),
kept as (
  select page_id, html, place, list_sort([p for p in string_split(query, '&')
    if p <> '' and not regexp_matches(p, '^(?i:utm_[a-z]+|ref|fbclid|gclid|sessionid)=')]) as q
  from canon
),
urls as (
  select page_id, place || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as canonical,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' as etag, strlen(coalesce(html, '')) as size, md5(coalesce(html, '')) as body
  from kept
),
last as (select canonical, max(page_id) as page_id from urls group by 1)
select 'v' || lpad(cast(v.page_id as varchar), 12, '0') as record_id, v.canonical, 200000000000 - v.page_id as ts,
  'r' || lpad(cast(r.page_id as varchar), 12, '0') as response_id, r.page_id as response_ts,
  case when v.etag = r.etag then 'resolved' else 'mismatch' end as outcome, v.etag as etag,
  case when v.etag = r.etag then cast(r.size as varchar) else '0' end as x_length, cast(200000000000 - v.page_id as varchar) as date,
  case when v.etag = r.etag then cast(r.size as bigint) else 0 end as payload_bytes,
  case when v.etag = r.etag then r.body else md5('') end as payload_md5
from urls v join last l on v.canonical = l.canonical join urls r on r.page_id = l.page_id
"""


# --- 10: mixing --------------------------------------------------------------------------

#: Target weights: the crawl source 'src0' is cut to the weight of two others.
MIX_WEIGHTS = {"src0": 2.0}
MIX_SEED = "mix"


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, MIX_WEIGHTS, seed=MIX_SEED, told_by=["text"])
    # from the texts that the shuffle brought here
    return out.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")))).drop("text")


OP10_SQL = """
with recursive sources as (
  select source, count(*) as n, case when source = 'src0' then 2.0::double else 1.0::double end as w
  from documents group by source
),
rates as (
  select source, w / (select sum(w) from sources) * (select count(*) from documents) / n as rate from sources
),
terms as (
  select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from terms
  where k < ceil(rate + 12 * sqrt(rate) + 30)
),
draws as (
  select doc_id, d.source, r.rate, text,
    cast(('0x' || substr(md5('mix:count:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13)) as bigint)
      / 4503599627370496.0::double as u
  from documents d join rates r on d.source is not distinct from r.source
),
counts as (
  select d.doc_id, d.source, d.rate, d.text, d.u, (
    select count(*) from terms t where t.source is not distinct from d.source and t.c <= d.u) as n
  from draws d
)
select doc_id, source, rate as mix_rate, cast(i as int) as mix_copy,
  md5('mix:order:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, 'null')) || ':' || i) as mix_key,
  md5(coalesce(text, '')) as text_md5
from (select *, unnest(range(n)) as i from counts where n > 0) t
"""


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_decontamination": op5_decontamination,
    "op6_media_columns": op6_media_columns,
    "op7_license_scan": op7_license_scan,
    "op8_token_ids": op8_token_ids,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_mix_sources": op10_mix_sources,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op7_license_scan": OP7_SQL,
    "op9_warc_revisits": OP9_SQL,
    "op10_mix_sources": OP10_SQL,
}
