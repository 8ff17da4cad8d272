"""Documents from posts, targets and text functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators import documents
from tallgrass.plans.register import catalogue
from tallgrass.plans.tables import read

QUERIES, SQL, query = catalogue()

BLANK = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _null(c):
    return "nullif(" + BLANK.format(c=c) + ", '')"


@query(f"select distinct id, coalesce({_null('text')}, {_null('original_post_text')}, nullif(concat_ws(' ', {_null('embed_title')}, {_null('embed_description')}), '')) as Document, coalesce(reply.parent.record.text, case when {_null('text')} is not null then {_null('original_post_text')} end) as ParentDocument from bluesky")
def documents_bluesky(spark, d):
    return documents.bluesky_documents(read(spark, d, "bluesky")).select("id", "Document", "ParentDocument").distinct()


@query(f"with o as (select distinct id, caption, ocr_text, ocr_mean_conf from instagram), f as (select id, {_null('caption.text')} as cap, case when ocr_mean_conf >= 0.75 then {BLANK.format(c=chr(114)+'egexp_replace(ocr_text, ' + chr(39) + r'\s+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} end as t from o), w as (select id, cap, case when len(regexp_extract_all(t, '\\p{{L}}{{3,}}')) >= 3 then substr(t, 1, 1000) end as t from f) select distinct id, concat_ws(chr(10), cap, t) as Document from w")
def documents_instagram(spark, d):
    return documents.instagram_documents(read(spark, d, "instagram")).select("id", "Document").distinct()


_TIKTOK = rf'''tt as (select video_id, arg_min({{'c': createtime, 'd': "desc", 's': seed, 't': transcripts}}, k) as v from (select *, row_number() over (partition by video_id order by createtime nulls first, "desc" nulls first) as k from tiktok) group by 1), au as (select cast(video_id as varchar) as video_id, cast(speaker_index as bigint) as speaker, bool_or(is_author) as is_author from speaker_author group by 1, 2), sg as (select video_id, unnest(v.t.segments) as s, generate_subscripts(v.t.segments, 1) as n from tt), kn as (select sg.video_id, n, s.start as start, {BLANK.format(c='s.text')} as text, au.speaker as speaker, is_author from sg join au on au.video_id = sg.video_id and au.speaker = try_cast(nullif(regexp_extract(s.speaker, '(\d+)\D*$', 1), '') as bigint)), rn as (select *, case when lag(speaker) over w is distinct from speaker then 1 else 0 end as new, count(distinct speaker) over (partition by video_id) > 1 as many from kn window w as (partition by video_id order by start nulls first, n)), tn as (select *, sum(new) over (partition by video_id order by start nulls first, n rows unbounded preceding) as turn from rn), sd as (select video_id, turn, case when any_value(is_author) or not any_value(many) then string_agg(text, ' ' order by start nulls first, n) else '"' || string_agg(text, ' ' order by start nulls first, n) || '"' end as said from tn group by 1, 2), sp as (select video_id, string_agg(said, ' ' order by turn) as spoken from sd group by 1), dt as (select tt.video_id as id, concat_ws(chr(10), {_null('v.d')}, {_null('spoken')}) as Document, v.s.SeedName as seed_name from tt left join sp using (video_id))'''


@query(f"with {_TIKTOK} select id, Document from dt")
def documents_tiktok(spark, d):
    return documents.tiktok_documents(read(spark, d, "tiktok"), read(spark, d, "speaker_author")).select("id", "Document")


_OCR = r"regexp_replace(regexp_replace(ocr_text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_ALL = f"""{_TIKTOK},
ub as (select 'bluesky' as platform, id, coalesce({_null('text')}, {_null('original_post_text')}, nullif(concat_ws(' ', {_null('embed_title')}, {_null('embed_description')}), '')) as own, coalesce(reply.parent.record.text, case when {_null('text')} is not null then {_null('original_post_text')} end) as parent, seed.SeedName as seed_name from bluesky),
ui as (select 'instagram' as platform, id, concat_ws(chr(10), {_null('caption.text')}, case when ocr_mean_conf >= 0.75 and len(regexp_extract_all({_OCR}, '\\p{{L}}{{3,}}')) >= 3 then substr({_OCR}, 1, 1000) end) as own, null as parent, seed.SeedName as seed_name from instagram),
ua as (select * from ub union all select * from ui union all select 'tiktok', id, Document, null, seed_name from dt)"""


@query(f"with {_ALL} select platform, id, case when parent is not null then parent || '; ' || own else own end as text, seed_name from ua where regexp_matches(own, '\\p{{L}}')")
def documents_all(spark, d):
    a = documents.bluesky_documents(read(spark, d, "bluesky"))
    b = documents.instagram_documents(read(spark, d, "instagram"))
    c = documents.tiktok_documents(read(spark, d, "tiktok"), read(spark, d, "speaker_author"))
    every = documents.usable(a.unionByName(b).unionByName(c))
    return every.select("platform", "id", documents.all_text(F.col("ParentDocument"), F.col("Document")).alias("text"), F.col("seed.SeedName").alias("seed_name"))


@query(
    r"""with t as (select distinct id, platform, unnest(Targets) as t, generate_subscripts(Targets, 1) as pos from (select distinct id, platform, Targets from doc_targets))
select id, platform, pos, regexp_replace(regexp_replace(ltrim(rtrim(regexp_replace(t, '\s*\([^)]*\)', ''), ',.:?!"''“”‘’…'), '@#"''“”‘’'), ',.*', ''), '^\s+|\s+$', '', 'g') as cleaned from t"""
)
def list_clean(spark, d):
    t = read(spark, d, "doc_targets").select("id", "platform", "Targets").distinct()
    return t.select("id", "platform", F.posexplode(documents.clean_targets(F.col("Targets"))).alias("pos", "cleaned")).select("id", "platform", (F.col("pos") + 1).cast("bigint").alias("pos"), "cleaned")


_FORMS = r"raw as (select unnest(Targets) as t from doc_targets), c as (select t, count(*) as n, lower(regexp_replace(t, '[^0-9\p{L}]+', '', 'g')) as key from raw where t is not null group by 1), f as (select t, first_value(t) over (partition by key order by n desc, length(t), t) as form from c)"


@query(f"with {_FORMS} select t as target, form from f where t <> form")
def spelling_canonical(spark, d):
    t = read(spark, d, "doc_targets").select(F.explode("Targets").alias("target"))
    return documents.spelling_forms(t).where("target <> form")


@query(f"with {_FORMS}, p as (select distinct id, platform, Targets from doc_targets), e as (select id, platform, unnest(Targets) as t, generate_subscripts(Targets, 1) as pos from p), m as (select id, platform, coalesce(form, e.t) as form, min(pos) as pos from e left join f on e.t = f.t group by 1, 2, 3), l as (select id, platform, list(form order by pos) as Targets from m group by 1, 2) select k.id, k.platform, coalesce(l.Targets, []) as Targets from (select distinct id, platform from p) k left join l using (id, platform)")
def targets_canonical(spark, d):
    t = read(spark, d, "doc_targets").select("id", "platform", "Targets")
    forms = documents.spelling_forms(t.select(F.explode("Targets").alias("target")))
    return documents.mapped_targets(t.distinct(), ["id", "platform"], forms)


@query("with t as (select unnest(Targets) as t from doc_targets), top as (select t from t where t is not null group by 1 order by count(*) desc, t limit 50) select id, platform, x as target from (select distinct id, platform, unnest(Targets) as x from doc_targets) where x in (select t from top)")
def common_targets(spark, d):
    rows = read(spark, d, "doc_targets").select("id", "platform", F.explode("Targets").alias("target")).where("target is not null")
    top = rows.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(50)
    return rows.distinct().join(F.broadcast(top.select("target")), "target", "left_semi").select("id", "platform", "target")  # 50 rows


@query("with w as (select distinct doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) as word from documents), p as (select word, count(*) as n, avg(case when lang <> 'en' then 1.0 when lang is not null then 0.0 end) as other from w group by 1), k as (select word, lang, count(*) as k from w where lang is not null group by 1, 2), t as (select word, lang, row_number() over (partition by word order by k desc, lang) as r from k) select p.word, n, round(other, 6) as other, lang as language from p left join t on p.word = t.word and r = 1")
def language_scores(spark, d):
    w = read(spark, d, "documents").select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word")).distinct()
    return documents.language_scores(w, "word", "lang").withColumn("other", F.round("other", 6))


@query(r"select doc_id, upper(substr(regexp_extract(text, '[a-z]+'), 1, 3)) as head, len(regexp_extract_all(text, '[aeiou]')) as vowels, split_part(text, ' ', 2) as second, length(text) as chars, strlen(text) as bytes, contains(text, 'the') as has_the, regexp_matches(text, '^(The|We|Join)') as opens from documents where text is not null")
def string_functions(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").where("text is not null").select(
        "doc_id", F.upper(F.substring(F.regexp_extract(t, "[a-z]+", 0), 1, 3)).alias("head"), F.regexp_count(t, F.lit("[aeiou]")).cast("bigint").alias("vowels"), F.split_part(t, F.lit(" "), F.lit(2)).alias("second"),
        F.length(t).cast("bigint").alias("chars"), F.octet_length(t).cast("bigint").alias("bytes"), t.contains("the").alias("has_the"), t.rlike("^(The|We|Join)").alias("opens"),
    )


@query("select distinct id, platform, case platform when 'twitter' then 'https://twitter.com/' || seed.Handle || '/status/' || id when 'tiktok' then 'https://www.tiktok.com/@' || seed.Handle || '/video/' || id when 'bluesky' then 'https://bsky.app/profile/' || split_part(id, '/', 1) || '/post/' || split_part(id, '/', -1) end as url from doc_targets")
def permalinks(spark, d):
    return read(spark, d, "doc_targets").select("id", "platform", text.permalink(F.col("platform"), F.col("seed.Handle"), F.col("id")).alias("url")).distinct()


@query("select lower(split_part(filter_value, '-', 2)) as platform, count(*) as n from target_df where trim(filter_value) <> '' group by 1")
def platform_from_key(spark, d):
    return read(spark, d, "target_df").where("trim(filter_value) <> ''").groupBy(text.platform_of(F.col("filter_value")).alias("platform")).agg(F.count("*").alias("n"))


@query("select case when contains(Document, '?') then 'question' when Document is not null then 'statement' end as label, count(*) as n from doc_targets group by 1")
def distinct_inference(spark, d):
    t = read(spark, d, "doc_targets").select("id", "platform", "Document")
    return documents.in_batches(t, "Document", "label", lambda texts: ["question" if "?" in t else "statement" for t in texts]).groupBy("label").agg(F.count("*").alias("n"))
