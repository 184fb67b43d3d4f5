"""Registered queries of this subpackage and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import (
    bpe, chat, decontam, lexical, licenses, minhash, negatives, ngram_join, quality, secrets, toxicity, urls, warc,
)
from corpusloom.llm.common import read
from corpusloom.session import scratch_path

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def quality_sql() -> str:
    tests = []
    for r in quality.RULES:
        op = ">=" if r.keeps == "at_least" else "<="
        tests.append(f"100 * {r.count} {op} {r.percent} * {r.base}")
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from d),
pos as (select rid, words, unnest(range(1, len(words) - 1)) i from w),
tri as (select rid, i, count(*) over (partition by rid, words[i] || ' ' || words[i+1] || ' ' || words[i+2]) n from pos),
rep as (select rid, count(distinct p) n from (select rid, unnest([i, i+1, i+2]) p from tri where n > 1) group by rid),
m as (select doc_id, len(words) n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
  len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines,
  coalesce(rep.n, 0) n_repeat_words,
  len(list_filter(words, lambda x: lower(x) in ({quoted(quality.STOP_WORDS)}))) n_stop_words,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) n_ellipsis_lines
  from w left join rep using (rid)),
j as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(tests)} kept from j"""


@query("op1_quality_rules", quality_sql())
def op1(spark, sf_dir):
    q = F.col("quality")
    return quality.quality(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *[q[c].alias(c) for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()],
    )


URL_RULES = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
#: A host is listed if one of its labels holds one of these words.
LISTED_WORDS = ("spam", "casino", "adult", "malware", "phish", "ads")
LISTED_HOST = r"(^|\.)[^.]*(" + "|".join(LISTED_WORDS) + r")[^.]*(\.|$)"
_RULE_SQL = " ".join(
    f"when (h = '{of}' or ends_with(h, '.{of}')) and starts_with(p, '/{start}') then '{value}'"
    for verdict, text in sorted(URL_RULES, key=lambda r: -len(r[1]))
    for of, _, start in [text.partition("/")]
    for value in ["{" + verdict + "|" + text + "}"]
)


def _rule_case(pick: int) -> str:
    out = _RULE_SQL
    for verdict, text in URL_RULES:
        out = out.replace("{" + verdict + "|" + text + "}", (verdict, text)[pick])
    return f"case {out} end"


URL_SQL = rf"""
with u as (select page_id, case when position('://' in url) > 0
    then substr(url, position('://' in url) + 3) else '' end r from pages),
k as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) p from u),
listed as (select distinct h from k where regexp_matches(h, '{LISTED_HOST}'))
select page_id, h as host, p as path, {_rule_case(1)} as rule,
  coalesce({_rule_case(0)}, case when exists (select 1 from listed l where k.h = l.h or ends_with(k.h, '.' || l.h))
    then 'block' else 'allow' end) as verdict from k"""


@query("op2_url_filters", URL_SQL)
def op2(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    host = urls.host_of(F.col("url"))
    listed = pages.select(host.alias("key")).where(F.col("key").rlike(LISTED_HOST)).distinct()
    return urls.url_filter(pages, listed, URL_RULES)


def license_sql() -> str:
    pairs = [(old, new) for old, new in licenses.SPELLINGS if " " in old]
    single = " ".join(f"when '{old}' then '{new}'" for old, new in licenses.SPELLINGS if " " not in old)

    def canon(text: str) -> str:
        lower = f"translate(regexp_replace({text}, '{licenses.COPYRIGHT_LINE}', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = f"trim(regexp_replace({lower}, '[^a-z0-9]+', ' ', 'g'))"
        for old, new in pairs:
            out = f"regexp_replace({out}, '\\b{old}\\b', '{new}', 'g')"
        return f"array_to_string(list_transform(string_split({out}, ' '), lambda w: case w {single} else w end), ' ')"

    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.KNOWN)
    long = ", ".join(f"('{n}', '{f}', {z}, '{d}')" for n, f, z, d in licenses.LONG_TEXTS)
    return f"""
with k as (select min(licence) licence, c from (select licence, {canon('text')} c from (values {known}) t(licence, text)) group by c),
kd as (select licence, array_to_string(string_split(c, ' ')[1:3], ' ') f, length(c) z, sha256(c) h from k
  union all select * from (values {long}) t(licence, f, z, h)),
d as (select row_number() over () rid, doc_id, ' ' || {canon("coalesce(text, '')")} || ' ' c from documents),
fs as (select distinct f from kd),
p as (select rid, c, f, unnest(range(1, length(c))) i from d join fs on contains(c, ' ' || f || ' ') or contains(c, ' ' || f)),
s as (select rid, licence, i, i + z e, z + 2 = length(c) w from p join kd using (f)
  where substr(c, i, length(f) + 1) = ' ' || f and substr(c, (i + z + 1)::bigint, 1) = ' ' and sha256(substr(c, (i + 1)::bigint, z::bigint)) = h),
m as (select *, max(e) over (partition by rid order by i, e desc rows between unbounded preceding and 1 preceding) b from s),
t as (select rid, string_agg(distinct licence, ',' order by licence) licences, count(*) filter (b is null or e > b) n, bool_or(w) w from m group by rid)
select doc_id, coalesce(licences, '') as licences, coalesce(n, 0) as n_notices, coalesce(w, false) as whole_text
from d left join t using (rid)"""


@query("op3_license_scans", license_sql())
def op3(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"), licenses.known_digests(spark))


CHAT_SQL = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(text, '([<\[]/?)(\\*)(s>|INST\]|SYS\]|TURN\]|SAID\])', '\1\\\2\3', 'g'))
  + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 7
    else 19 + length(regexp_replace(role, '([<\[]/?)(\\*)(s>|INST\]|SYS\]|TURN\]|SAID\])', '\1\\\2\3', 'g')) end n from r)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars
from e group by conv_id"""


@query("op4_chat_formatting", CHAT_SQL)
def op4(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"select * from values (-7L, 0L, 'user', '{odd}'), (-7L, 1L, 'assistant', '{odd}')"
        " as t(conv_id, turn, role, text)"
    )
    turns = F.col("turns")
    done = chat.format_chats(rows.unionByName(extra)).withColumn(
        "loss", F.array_join(F.transform(F.filter(turns, lambda t: t["loss"]), lambda t: t["text"]), "")
    )
    said = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op6_secret_scans")
def op6(spark, sf_dir):
    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return secrets.secret_scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def tokenizer() -> tuple[str, str]:
    """Rank file and splitting pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op7_byte_bpe")
def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.bpe_encode(docs, *tokenizer()).select("doc_id", "ids")
    return bpe.bpe_decode(coded, *tokenizer()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


DECONTAM_SQL = r"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select coalesce(item_id::varchar, '') item, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
bw as (select item, least(10, len(w)) n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i, w from b where len(w) > 0),
win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') g from bw),
lens as (select distinct n from win),
dw as (select rid, n, w, unnest(range(1, len(w) - n + 2)) i from d, lens where len(w) >= n),
hit as (select rid, i, dw.n, item from (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') g from dw) dw
    join win on dw.g = win.g and dw.n = win.n),
cov as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + n)) p from hit) group by rid),
its as (select rid, count(distinct item) n, string_agg(distinct item, ',' order by item) s from hit group by rid)
select doc_id, len(w)::bigint n_words, coalesce(cov.n, 0)::bigint n_hit, coalesce(its.n, 0)::bigint n_items,
  sha256(coalesce(its.s, '')) items_sha256, coalesce(cov.n, 0) > 0 contaminated
from d left join cov using (rid) left join its using (rid)"""


@query("op8_decontamination", DECONTAM_SQL)
def op8(spark, sf_dir):
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.learn(docs, labels.where(fold != 0))
    return toxicity.score(docs, model).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


WARC_SQL = """
with p as (select page_id, coalesce(html, '') t from pages),
h as (select page_id, strlen(t) n, sha1(t) x, max(page_id) over (partition by t) m from p)
select page_id, n as payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31)::bigint, 1)),
    'string_agg', '') as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type,
  case when page_id <> m then m end as refers_to from h"""


@query("op5_warc", WARC_SQL)
def op5(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = warc.write_warc(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"), parts)
    return warc.read_warc(spark, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op10_minhash_dedup")
def op10(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
with v as (select row_number() over () rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
    list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
s as (select a.rid, a.vec_id anchor_id, c.vec_id, c.l = a.l same, list_inner_product(a.q, c.q)::bigint score
  from v a join v c on a.vec_id % 100 = 0 and a.rid <> c.rid),
p as (select * from (select *, row_number() over (partition by rid order by score desc, vec_id) k from s where same) where k <= 5),
n as (select p.anchor_id, p.vec_id positive_id, p.score positive_score, s.vec_id negative_id, s.score negative_score,
    row_number() over (partition by p.rid, p.k order by s.score desc, s.vec_id) rank
  from p join s on p.rid = s.rid and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 10"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


LEXICAL_SQL = r"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select row_number() over () qid, item_id, list_distinct(list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) w from benchmark),
al as (select count(*) filter (len(w) > 0) nn, coalesce(sum(len(w)), 0)::bigint ll from d),
m as (select rid, doc_id, 10 + ((90 * len(w) * nn) // ll) m from d, al where len(w) > 0),
q as (select qid, item_id, unnest(w) t from b),
tf as (select rid, t, count(*) tf from (select rid, unnest(w) t from d) where t in (select t from q) group by all),
df as (select t, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::bigint w from tf, al group by t),
s as (select qid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from q join tf using (t) join df using (t) join m using (rid) group by all)
select item_id, rank::integer as rank, doc_id, score from (
  select *, row_number() over (partition by qid order by score desc, doc_id) rank from s where score > 0) where rank <= 10"""


@query("op12_lexical_search", LEXICAL_SQL)
def op12(spark, sf_dir):
    return lexical.lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


NGRAM_SQL = r"""
with recursive d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct rid, array_to_string(w[i:i + 3], ' ') g
    from (select rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from d where len(w) > 0)),
n as (select rid, count(*) n from s group by rid),
i as (select a.rid a, b.rid b, count(*) i from s a join s b on a.g = b.g and a.rid <> b.rid group by all),
l as (select a, b from i join n na on na.rid = a join n nb on nb.rid = b where 100 * i >= 85 * (na.n + nb.n - i)),
r as (select rid, rid x from d union select r.rid, l.b from r join l on l.a = r.x),
c as (select r.rid, min(d.doc_id) c from r join d on d.rid = r.x group by r.rid)
select doc_id, coalesce(n.n, 0) as n_shingles, c.c as component_id from d join c using (rid) left join n using (rid)"""


@query("op13_ngram_join", NGRAM_SQL)
def op13(spark, sf_dir):
    return ngram_join.ngram_links(read(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
