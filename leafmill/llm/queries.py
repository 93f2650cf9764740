"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    bpe,
    decontamination,
    fingerprints,
    hard_negatives,
    html_crf,
    line_dedup,
    ngram_join,
    periodic_runs,
    quality,
    quotations,
    sharding,
    toxicity,
    warc,
)
from leafmill.plans.registry import query
from leafmill.session import load


@query()
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    rows = fingerprints.edited_fingerprints(load(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.encoded(F.col("sketch")).alias("fingerprint"),
        fingerprints.encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query()
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    found = ngram_join.classes(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_id", "copies", "class_id", "links")


@query()
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_crf.extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query()
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones, exactly or up to one word."""
    return line_dedup.deduplicated(load(spark, sf_dir, "documents")).select("doc_id", "text", "lines", "removed")


@query(
    """
    with p as (select page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) h from pages),
    d as (
      select *, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * i::int, 5))::bigint >> (15 - 5 * j::int)) & 31))::int, 1)
      ), 'string_agg', '')), 'string_agg', '') digest, min(page_id) over (partition by h) first_id
      from p)
    select page_id, octet_length(b) payload_bytes, digest payload_digest,
      case when page_id = first_id then 'response' else 'revisit' end record_type,
      case when page_id <> first_id then first_id end refers_to
    from d
    """
)
def op5_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into web archives and read back from the normalised ones."""
    rows = warc.archived(load(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    docs = load(spark, sf_dir, "documents")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    return sharding.sharded(docs.withColumn("text_crc32", crc)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _template_sql(text: str) -> dict[str, str]:
    """SQL for the template words of a text and for what its placeholders stand for."""
    d = decontamination
    names, marked = d.NAMES.replace("'", "''"), f"regexp_replace({text}, '{d.NAMES}', '\\1{d.NAME}', 'g')"
    numbered = f"regexp_replace({marked}, '{d.NUMBERS}', ' {d.NUMBER} ', 'g')"
    measured = f"regexp_replace({numbered}, '{d.MEASURED}', '{d.NUMBER} {d.UNIT}', 'g')"
    return {
        "words": f"list_filter(string_split_regex(lower({measured}), '{d.BETWEEN}'), lambda x: x <> '')",
        "numbers": f"regexp_extract_all({marked}, '{d.NUMBERS}')",
        "units": f"list_transform(regexp_extract_all({numbered}, '{d.MEASURED}', 1), lambda x: lower(x))",
        "names": f"list_transform(regexp_extract_all({text}, '{names}', 2), lambda x: lower(x))",
    }


_TEMPLATE = ", ".join(f"{sql} as {name}" for name, sql in _template_sql("text").items())
_MARKS = f"('{decontamination.NUMBER}', '{decontamination.UNIT}', '{decontamination.NAME}')"
LEAKS = f"""
    with docs as (select *, {_TEMPLATE} from (select distinct doc_id, coalesce(text, '') as text from documents)),
    items as (select *, {_TEMPLATE} from (select distinct text from benchmark where text is not null)),
    sizes as (select distinct least({decontamination.WINDOW}, len(words)) as size from items where len(words) > 0),
    item_windows as (
      select text as item, size, i, array_to_string(words[i : i + size - 1], ' ') as w, len(words) - size + 1 as whole
      from items, sizes, unnest(range(1, len(words) - size + 2)) as t(i)
      where size = least({decontamination.WINDOW}, len(words))
        and len(list_filter(words[i : i + size - 1], lambda x: x not in {_MARKS})) >= least({decontamination.LITERAL}, (size + 1) // 2)),
    doc_windows as (
      select doc_id, text, size, i, array_to_string(words[i : i + size - 1], ' ') as w
      from docs, sizes, unnest(range(1, len(words) - size + 2)) as t(i)),
    passages as (
      select d.doc_id, d.text, w.item, w.whole, d.i - w.i as shift, count(distinct w.i) as windows, min(w.i) as first, max(w.i) + w.size - 1 as last
      from doc_windows d join item_windows w using (size, w) group by d.doc_id, d.text, w.item, w.whole, w.size, shift
      having count(distinct w.i) >= least(w.whole, {decontamination.PASSAGE - decontamination.WINDOW + 1})),
    slots as (
      select p.*, i.words[pl] as kind,
        len(list_filter(i.words[1 : pl], lambda x: x = i.words[pl])) as i_nth,
        len(list_filter(d.words[1 : pl + shift], lambda x: x = i.words[pl])) as d_nth,
        i.numbers as i_numbers, i.units as i_units, i.names as i_names, d.numbers as d_numbers, d.units as d_units, d.names as d_names
      from passages p join docs d on d.doc_id is not distinct from p.doc_id and d.text = p.text join items i on i.text = p.item,
        unnest(range(first, last + 1)) as t(pl)
      where i.words[pl] in {_MARKS} and i.words[pl] = d.words[pl + shift]),
    held as (
      select *, case kind when '{decontamination.NUMBER}' then i_numbers[i_nth] when '{decontamination.UNIT}' then i_units[i_nth] else i_names[i_nth] end as i_value,
        case kind when '{decontamination.NUMBER}' then d_numbers[d_nth] when '{decontamination.UNIT}' then d_units[d_nth] else d_names[d_nth] end as d_value
      from slots),
    judged as (
      select doc_id, text, item, shift, count(distinct (kind, i_value, d_value)) as pairs, count(distinct (kind, i_value)) as ours,
        count(distinct (kind, d_value)) as theirs, bool_or(i_value <> d_value) as changed from held group by doc_id, text, item, shift),
    found as (
      select p.doc_id, p.text, p.item, max(windows) as windows, max(whole) as whole, bool_and(coalesce(changed, false)) as changed
      from passages p left join judged j on j.doc_id is not distinct from p.doc_id and j.text = p.text and j.item = p.item and j.shift = p.shift
      where j.item is null or (pairs = ours and pairs = theirs) group by p.doc_id, p.text, p.item)
    select doc_id, item_id, windows, windows / whole as share, changed
    from found join (select distinct item_id, text as item from benchmark) b using (item)
"""


@query(LEAKS)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with the same or with other parameters."""
    return decontamination.found_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query()
def op9_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids and back."""
    rows = bpe.encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


REPLIES = r"""
    with recursive m as (
      select distinct conv_id, turn, text, regexp_matches(text, '(?m)^\s*>') as quoting from conversations
      where turn is not null and text is not null),
    l as (
      select conv_id, turn, text, i as pos, string_split_regex(text, '\r?\n')[i] as line
      from m, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) as t(i) where quoting),
    v as (
      select *, length(regexp_replace(regexp_extract(line, '^(?:\s*>)+'), '[^>]', '', 'g')) as lvl,
        regexp_replace(line, '^(?:\s*>)+', '') as body from l),
    w as (
      select *, lag(lvl) over (partition by conv_id, turn, text order by pos) as before,
        lead(lvl, 1, 0) over (partition by conv_id, turn, text order by pos) as after from v),
    r as (
      select *, sum((before is distinct from lvl)::int) over (partition by conv_id, turn, text order by pos) as run from w),
    passages as (
      select conv_id, turn, lvl, string_agg(body, ' ' order by pos) as t from r where lvl > 0 group by conv_id, turn, text, run, lvl
      union all select conv_id, turn, lvl, body from r where lvl > 0),
    quoted as (
      select distinct conv_id, turn, lvl, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) as key from passages),
    kept as (
      select conv_id, turn, text, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) order by pos) filter (
          where lvl = 0 and not (after > 0 and regexp_matches(line, '(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$'))), ''),
        '^\s+', ''), '\s+$', '') as own
      from r group by conv_id, turn, text),
    owned as (select conv_id, turn, text, own from kept union all select conv_id, turn, text, text from m where not quoting),
    own_keys as (
      select distinct conv_id, turn, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) as key
      from owned, unnest([own] || string_split_regex(own, '\n\s*\n') || string_split_regex(own, '\r?\n')) as u(t)),
    firsts as (select conv_id, key, min(turn) as origin from own_keys where key <> '' group by conv_id, key),
    links as (
      select q.conv_id, q.turn, q.lvl, f.origin from quoted q
      join firsts f on q.conv_id is not distinct from f.conv_id and q.key = f.key and f.origin < q.turn),
    parents as (
      select conv_id, turn, max(origin) as parent from (
        select *, min(lvl) over (partition by conv_id, turn) as outermost from links) where lvl = outermost group by conv_id, turn),
    up as (
      select conv_id, turn, parent, parent as root, 1 as depth from parents
      union all select up.conv_id, up.turn, up.parent, p.parent, up.depth + 1 from up
      join parents p on p.conv_id is not distinct from up.conv_id and p.turn = up.root),
    threads as (select conv_id, turn, parent, arg_max(root, depth) as root, max(depth) as depth from up group by conv_id, turn, parent)
    select c.conv_id, c.turn, c.role,
      case when regexp_matches(c.text, '(?m)^\s*>') then (
        select regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) order by pos) filter (
            where lvl = 0 and not (after > 0 and regexp_matches(line, '(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$'))), ''),
          '^\s+', ''), '\s+$', '')
        from (select *, lead(lvl, 1, 0) over (order by pos) as after from (
          select i as pos, s[i] as line, length(regexp_replace(regexp_extract(s[i], '^(?:\s*>)+'), '[^>]', '', 'g')) as lvl
          from (select string_split_regex(c.text, '\r?\n') as s), unnest(range(1, len(s) + 1)) as t(i))))
        else c.text end as text,
      t.parent as parent_turn, coalesce(t.root, c.turn) as thread, coalesce(t.depth, 0)::bigint as depth
    from conversations c left join threads t on c.conv_id is not distinct from t.conv_id and c.turn = t.turn
"""


@query(REPLIES)
def op10_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order, without their quotes."""
    return quotations.conversations(load(spark, sf_dir, "conversations"))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth document by crc32 of its id with words that repeat from some place on."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # bound as elements of arrays, which are computed once for all that refer to them
    bound = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda x: _tail_repeated(x["w"], x["g"]))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(bound, F.lit(0))).otherwise(text)


def _tail_repeated(words: Column, g: Column) -> Column:
    n = F.size(words).cast("long")
    first = g % n
    bound = F.array(F.struct(first.alias("first"), (1 + F.floor((n - first) / (3 + g % 8))).alias("period")))
    rest = F.transform(bound, lambda x: _repeated(words, x["first"], x["period"]))
    return F.array_join(F.concat(F.slice(words, F.lit(1), first.cast("int")), F.get(rest, F.lit(0))), " ")


def _repeated(words: Column, first: Column, period: Column) -> Column:
    places = F.sequence(first, F.size(words).cast("long") - 1)
    return F.transform(places, lambda i: F.get(words, (first + (i - first) % period).cast("int")))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, the longest one and the text without repeats."""
    docs = load(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    rows = periodic_runs.with_runs(docs, keep=["doc_id"]).select("doc_id", "periodic.runs", "periodic.collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.array_join(lines, "").alias("written"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        (-F.col("m.before")).alias("start"),
        F.col("m.length").alias("length"),
        (-F.col("m.shorter")).alias("period"),
        F.expr("1000 * m.length div -m.shorter").alias("exponent_milli"),
        F.sha2("written", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


NEGATIVES = """
    with v as (
      select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as e
      from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (
      select a.id as anchor_id, r.id, a.label = r.label as own, list_inner_product(a.e, r.e)::bigint as score
      from v a, v r where a.id % 50 = 0 and a.id <> r.id),
    positives as (
      select anchor_id, id as positive_id, score as positive_score from pairs where own
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
    select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id)::int as rank,
      n.id as negative_id, p.positive_score, n.score as negative_score
    from positives p join pairs n on n.anchor_id = p.anchor_id and not n.own
      and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
    qualify rank <= 3
"""


@query(NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, with every seventh label moved on by one."""
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(load(spark, sf_dir, "embeddings").withColumn("label", moved))


@query()
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
