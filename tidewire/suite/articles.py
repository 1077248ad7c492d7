"""URL and text functions, cleaning passes, extraction, language."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import html, text, urls
from tidewire.operators.dedup import first_ids
from tidewire.plans import article_cleaning as cleaning
from tidewire.plans import extraction, language
from tidewire.session import stage_path, staged
from tidewire.sources import models as stored
from tidewire.suite import inputs
from tidewire.suite.inputs import SQL_SPACE, sql_clean_article, sql_collapse, sql_strip
from tidewire.suite.registry import query, r6, rounded, table, text_table

_URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)"


def _sql_normalized(url: str) -> str:
    return f"""(
    case when regexp_extract({url}, '{_URL_PATTERN}', 1) <> ''
      then lower(regexp_extract({url}, '{_URL_PATTERN}', 1)) || ':' else '' end
    || regexp_replace(lower(regexp_extract({url}, '{_URL_PATTERN}', 2)), '^//www\\.', '//')
    || regexp_replace(regexp_extract({url}, '{_URL_PATTERN}', 3), '/+$', ''))"""


_PAGES_CTE = f"""
pages_norm as (
  select page_id, url, {_sql_normalized('url')} as url_norm,
    substr(lower(regexp_extract(url, '{_URL_PATTERN}', 2)), 3) as domain
  from pages
)
"""


@query(f"with {_PAGES_CTE} select page_id, url_norm, domain from pages_norm")
def url_normalize(spark, sf_dir):
    url = F.col("url")
    return text_table(spark, sf_dir, "pages", "page_id").select(
        "page_id", urls.normalize_url(url).alias("url_norm"), urls.domain_of(url).alias("domain")
    )


@query(f"""
with {_PAGES_CTE}
select domain, count(*) as n, count(distinct url_norm) as n_urls,
  count(*) filter (where regexp_matches(lower(url), '{fv.NAVIGATION_URL}')) as n_navigation
from pages_norm group by domain
""")
def url_domain(spark, sf_dir):
    url = F.col("url")
    counted = (
        text_table(spark, sf_dir, "pages", "page_id")
        .groupBy(urls.domain_of(url).alias("domain"), urls.normalize_url(url).alias("url_norm"))
        .agg(F.count("*").alias("n"), F.count_if(urls.is_navigation(url)).alias("n_navigation"))
    )
    return counted.groupBy("domain").agg(
        F.sum("n").alias("n"), F.count("url_norm").alias("n_urls"), F.sum("n_navigation").alias("n_navigation")
    )


def _sql_quality(value: str) -> str:
    letters = rf"length(regexp_replace({value}, '[^\p{{L}}]+', '', 'g'))"
    latin = f"length(regexp_replace({value}, '[^A-Za-zÀ-ÖØ-öø-ÿ]+', '', 'g'))"
    return f"""
    length({value}) as text_len_clean,
    case when length({value}) = 0 then 0 else {letters} / length({value}) end as alpha_ratio,
    case when {letters} = 0 then 0 else {latin} / {letters} end as latin_ratio,
    case when length({value}) = 0 then 0
      else (length({value}) - length(translate({value}, 'ï»¿', ''))) / length({value}) end as weird_char_ratio"""


_FLAG_SQL = """case when weird_char_ratio > 0.01 then 'encoding_noise'
    when alpha_ratio < 0.5 then 'low_alpha' else 'ok' end as quality_flag"""
_RATIOS = f"{r6('alpha_ratio', 'alpha_ratio')}, {r6('latin_ratio', 'latin_ratio')}, {r6('weird_char_ratio', 'weird_char_ratio')}"


@query(f"""
with cleaned as (select doc_id, {sql_clean_article('text')} as t from documents),
measured as (select doc_id, {_sql_quality('t')} from cleaned)
select doc_id, cast(text_len_clean as int) as text_len_clean, {_RATIOS}, {_FLAG_SQL} from measured
""")
def text_quality(spark, sf_dir):
    cleaned = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", text.clean_article(F.col("text")).alias("text_clean"))
    return rounded(cleaning.with_quality(cleaned).drop("text_clean"))


def _garbled(value):
    """Break documents the way a wrong code page does."""
    broken = F.replace(value, F.lit(", "), F.lit("â€¦ "))
    broken = F.replace(broken, F.lit(" the "), F.lit(" â€œtheâ€ "))
    broken = F.replace(broken, F.lit(" de "), F.lit("Â deâ€”"))
    return F.replace(broken, F.lit("."), F.lit("â€™ï»¿"))


_GARBLED_SQL = (
    "replace(replace(replace(replace(text, ', ', 'â€¦ '), ' the ', ' â€œtheâ€ '), ' de ', 'Â deâ€”'), '.', 'â€™ï»¿')"
)


def _sql_fixed(value: str) -> str:
    for bad, good in sorted(fv.MOJIBAKE.items(), key=lambda pair: -len(pair[0])):  # longer entries first
        quoted = good.replace("'", "''")
        value = f"replace({value}, '{bad}', '{quoted}')"
    return sql_collapse(f"replace({value}, chr(65279), ' ')")


@query(f"""
with fixed as (select doc_id, {_sql_fixed(_GARBLED_SQL)} as t from documents)
select doc_id, md5(t) as digest, cast(length(t) as int) as n from fixed
""")
def fix_encoding(spark, sf_dir):
    fixed = text_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", text.fix_encoding(_garbled(F.col("text"))).alias("t")
    )
    return fixed.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


def _sql_words(word: str) -> str:
    return rf"cast(len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: x = '{word}')) as int)"


@query(f"""
select doc_id, {_sql_words('more')} as n_more, {_sql_words('the')} as n_the, {_sql_words('de')} as n_de,
  cast((length(text) - length(replace(text, ', ', ''))) / 2 as int) as n_commas
from documents
""")
def word_counts(spark, sf_dir):
    value = F.col("text")
    return text_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        text.count_word(value, "More").alias("n_more"),
        text.count_word(value, "The").alias("n_the"),
        text.count_word(value, "de").alias("n_de"),
        text.count_substring(value, ", ").alias("n_commas"),
    )


_PASS1_CTE = f"""
usable as (
  select *, {sql_clean_article('text')} as text_clean from article_text
  where extract_success and not contains(lower(extract_method), 'download_failed') and text is not null
),
by_url as (
  select * from usable where length(text_clean) >= 200
  qualify row_number() over (partition by url_norm order by doc_id) = 1
),
by_text as (select * from by_url qualify row_number() over (partition by text_clean order by doc_id) = 1),
measured as (select *, {_sql_quality('text_clean')} from by_text),
pass1 as (select *, {_FLAG_SQL} from measured)
"""


@query(f"""
with {inputs.ARTICLE_CTE}, {_PASS1_CTE}
select doc_id, news_date, url, url_norm, source, domain, extract_success, extract_method,
  cast(text_len_clean as int) as text_len_clean, {_RATIOS}, quality_flag, lang,
  lang = 'en' and latin_ratio >= 0.85 and quality_flag = 'ok' as is_english, md5(text_clean) as text_clean,
  is_core_climate, is_policy_regulation, is_physical_risk, is_energy_geopolitics, is_cleantech,
  is_activism_litigation, {r6('tone_score', 'tone_score')}
from pass1
""")
def clean_pass1(spark, sf_dir):
    cleaned = cleaning.clean_pass1(inputs.article_text(spark, sf_dir), "doc_id")
    return rounded(cleaned.withColumn("text_clean", F.md5("text_clean")))


_BLOCKED = ["www.src9.example.com"]
_PASS2_LIMITS = {"blocked": _BLOCKED, "junk_words": {"the": 150, "les": 20}, "max_separators": 40}

_PASS2_CTE = f"""
garbled as (select * exclude (text), {_GARBLED_SQL} as text from article_text),
repaired as (select *, {_sql_fixed('text')} as text_clean from garbled),
ruled as (
  select doc_id, text_clean,
    case when regexp_matches(lower(url), '{fv.NAVIGATION_URL}') then 'navigation_url'
      when domain in ('www.src9.example.com') then 'blocked_domain'
      when not (length(text_clean) between 200 and 20000) then 'length'
      when {_sql_words('the').replace('lower(text)', 'lower(text_clean)')} > 150
        or {_sql_words('les').replace('lower(text)', 'lower(text_clean)')} > 20
        or contains(lower(text_clean), '#name?')
        or (length(text_clean) - length(replace(text_clean, ' - ', ''))) / 3 > 40 then 'junk'
      else 'kept' end as rule
  from repaired
)
"""


def _pass2_input(spark, sf_dir):
    rows = inputs.article_text(spark, sf_dir)
    return rows.withColumn("text_clean", _garbled(F.col("text"))).drop("text")


@query(f"""
with {inputs.ARTICLE_CTE}, {_PASS2_CTE}
select doc_id, md5(text_clean) as digest from ruled where rule = 'kept'
qualify row_number() over (partition by text_clean order by doc_id) = 1
""")
def clean_pass2(spark, sf_dir):
    kept = cleaning.clean_pass2(_pass2_input(spark, sf_dir), "doc_id", **_PASS2_LIMITS)
    return kept.select("doc_id", F.md5("text_clean").alias("digest"))


@query(f"""
with {inputs.ARTICLE_CTE}, {_PASS2_CTE},
kept as (select count(*) as n, count(distinct text_clean) as d from ruled where rule = 'kept')
select * from (
  select rule, count(*) as n from ruled where rule <> 'kept' group by rule
  union all select 'kept', d from kept
  union all select 'duplicate', n - d from kept
) where n > 0
""")
def removed_by_rule(spark, sf_dir):
    return cleaning.removed_by_rule(_pass2_input(spark, sf_dir), **_PASS2_LIMITS)


@query(f"""
with {_PAGES_CTE}
select min(page_id) as page_id, url_norm, count(*) as n_copies from pages_norm group by url_norm
""")
def dedup_url(spark, sf_dir):
    pages = text_table(spark, sf_dir, "pages", "page_id").select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"))
    kept = pages.join(first_ids(pages, "page_id", [{"url": F.col("url_norm")}]), "page_id", "left_semi")
    copies = pages.groupBy("url_norm").agg(F.count("*").alias("n_copies"))
    return kept.join(copies, "url_norm").select("page_id", "url_norm", "n_copies")


@query("""
select doc_id, lang, source from documents
qualify row_number() over (partition by text order by doc_id) = 1
""")
def dedup_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    kept = first_ids(rows, "doc_id", [{"text": text.text_digest(F.col("text"))}])
    return rows.select("doc_id", "lang", "source").join(kept, "doc_id", "left_semi")


@query("""
with slim as (select turn, role, text, conv_id from conversations),
numbered as (select *, conv_id * 1000 + turn as row_id from slim),
by_pair as (select * from numbered qualify row_number() over (partition by role, length(text) order by row_id) = 1)
select row_id from by_pair qualify row_number() over (partition by md5(lower(text)) order by row_id) = 1
""")
def dedup_in_steps(spark, sf_dir):
    """Keep-first by two columns, then by text, as the URL list and the texts are."""
    rows = table(spark, sf_dir, "conversations").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    pair = {"role": F.col("role"), "size": F.length("text")}
    return first_ids(rows, "row_id", [pair, {"text": F.md5(F.lower("text"))}])


def _sql_without(value: str, name: str) -> str:
    return rf"regexp_replace({value}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', ' ', 'g')"


_ENTITIES = {"copy": "©", "middot": "·", "nbsp": " ", "quot": '"', "lt": "<", "gt": ">", "apos": "''", "#39": "''", "amp": "&"}


def _sql_decoded(value: str) -> str:
    for name, char in _ENTITIES.items():
        value = f"replace({value}, '&{name};', '{char}')"
    return value


def _sql_extract() -> str:
    page = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for name in (*html.HIDDEN, *html.FURNITURE):
        page = _sql_without(page, name)
    rest = "page"
    for name in html.MENUS:
        rest = _sql_without(rest, name)
    inline = rf"(?i)</?(?:{html.INLINE})(?:\s[^>]*)?>"
    tag = "</?[A-Za-z!][^>]*>"
    article = r"array_to_string(regexp_extract_all(page, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1), ' ')"
    stripped = rf"regexp_replace(regexp_replace(article, '{inline}', '', 'g'), '{tag}', ' ', 'g')"
    body = rf"regexp_replace(regexp_replace({rest}, '(?is)^.*?<body\b[^>]*>', ''), '[\r\n]+', ' ', 'g')"
    linked = rf"regexp_replace(regexp_replace({body}, '(?i)<a(?:\s[^>]*)?>', chr(1), 'g'), '(?i)</a\s*>', chr(2), 'g')"
    lines = rf"string_split(regexp_replace(regexp_replace({linked}, '{inline}', '', 'g'), '{tag}', chr(10), 'g'), chr(10))"
    whole = sql_collapse(r"regexp_replace(x, '[\x01\x02]', '', 'g')")
    own = sql_collapse(r"regexp_replace(x, '\x01[^\x02]*\x02?', '', 'g')")
    kept = rf"""array_to_string(list_transform(list_filter({lines}, lambda x: length({whole}) > 0 and 2 * length({own}) > length({whole})),
      lambda x: regexp_replace(x, '[\x01\x02]', '', 'g')), ' ')"""
    return f"""
    with given as (select page_id, {_SQL_GIVEN} as html from pages),
    stripped as (select page_id, html is null as failed, {page} as page from given),
    bodies as (select page_id, failed, page, {article} as article from stripped),
    texts as (select page_id, failed, {sql_collapse(_sql_decoded(stripped))} as first, {sql_collapse(_sql_decoded(kept))} as second from bodies),
    chosen as (
      select page_id, failed, coalesce(length(first) < 300 and length(second) >= 300, false) as rescued,
        case when length(first) >= 300 then first when length(second) >= 300 then second end as t from texts)
    """


# every fifth page has no article and no paragraph, another fifth was never fetched
_SQL_GIVEN = """case page_id % 5 when 2 then null when 3 then
  replace(replace(replace(replace(html, '<article>', '<section>'), '</article>', '</section>'), '<p>', '<div>'), '</p>', '</div>') else html end"""


@query(f"""
{_sql_extract()}
select page_id, t is not null as extract_success,
  case when failed then '{fv.DOWNLOAD_FAILED}' when rescued then 'fallback_html' else 'primary_html' end as extract_method,
  cast(coalesce(length(t), 0) as int) as text_len, md5(t) as digest
from chosen
""")
def extract_text(spark, sf_dir):
    """Articles, pages that only the second reading can read, and pages that were not fetched."""
    pages = text_table(spark, sf_dir, "pages", "page_id")
    plain = F.col("html")
    for old, new in (("<article>", "<section>"), ("</article>", "</section>"), ("<p>", "<div>"), ("</p>", "</div>")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    kind = F.col("page_id") % 5
    pages = pages.withColumn("html", F.when(kind == 3, plain).when(kind != 2, F.col("html")))
    extracted = extraction.extract_text(pages)
    return extracted.select(
        "page_id", "extract_success", "extract_method", "text_len", F.md5("text").alias("digest")
    )


@query()
def article_pipeline(spark, sf_dir):
    """Pages through extraction and both cleaning passes; language from profiles."""
    profile = language.fit_slots(text_table(spark, sf_dir, "documents", "doc_id"), "text", "lang", ["en", "fr", "de", "es"])
    pages = text_table(spark, sf_dir, "pages", "page_id").withColumns(
        {"url_norm": urls.normalize_url(F.col("url")), "domain": urls.domain_of(F.col("url"))}
    )
    extracted = staged(extraction.extract_text(pages), "extracted")
    first = cleaning.clean_pass1(
        extracted, "page_id", with_language=lambda rows: language.language_in_row(rows, "text_clean", profile)
    )
    second = cleaning.clean_pass2(staged(first, "cleaned").filter("is_english"), "page_id")
    return rounded(second.withColumn("text_clean", F.md5("text_clean")))


_LANGS = ["en", "fr", "de", "es"]


def _sql_detect() -> str:
    sums = ", ".join(f"coalesce(sum(n) filter (where lang = '{x}'), 0) as {x}" for x in _LANGS)
    logs = ", ".join(f"ln(({x} + 1) / (sum({x}) over () + count(*) over ())) as {x}" for x in _LANGS)
    totals = ", ".join(f"round(sum(p.{x}), 6) as {x}" for x in _LANGS)
    top = "greatest(en, fr, de, es)"
    return rf"""
with tokens as (
  select doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as word from documents
),
counts as (select lang, word, count(*) as n from tokens group by all),
profile_counts as (select word, {sums} from counts where lang in ('en', 'fr', 'de', 'es') group by word),
profiles as (select word, {logs} from profile_counts),
scores as (select doc_id, {totals} from tokens t join profiles p using (word) group by doc_id)
select d.doc_id, case when s.doc_id is null then 'unknown'
  when en = {top} then 'en' when fr = {top} then 'fr' when de = {top} then 'de' else 'es' end as lang
from documents d left join scores s using (doc_id)
"""


@query(_sql_detect())
def detect_language(spark, sf_dir):
    documents = text_table(spark, sf_dir, "documents", "doc_id")
    profiles = language.fit_profiles(documents, "text", "lang", _LANGS)
    return language.detect_language(documents, "doc_id", "text", profiles)


@query(_sql_detect())
def detect_language_by_stored_profiles(spark, sf_dir):
    """The same languages by profiles that were saved and loaded."""
    documents = text_table(spark, sf_dir, "documents", "doc_id")
    path = stage_path(spark, "profiles")
    stored.save_profiles(language.fit_profiles(documents, "text", "lang", _LANGS), "string", "text", path)
    profiles = stored.load_profiles(spark, path, scored=documents)
    return language.detect_language(documents, "doc_id", "text", profiles)


def _sql_slots() -> str:
    sums = ", ".join(f"count(*) filter (where lang = '{x}') as {x}" for x in _LANGS)
    logs = ", ".join(
        f"cast(round(ln(({x} + 1) / ((select sum({x}) from counts) + (select count(*) from counts))) * {language.PARTS}) as bigint) as {x}"
        for x in _LANGS
    )
    totals = ", ".join(f"sum(p.{x}) as {x}" for x in _LANGS)
    top = "greatest(en, fr, de, es)"
    return rf"""
with tokens as (
  select doc_id, lang, substr(md5(doc_id::varchar), 1, 1) < '4' as held_out,
    unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as word from documents
),
slotted as (select *, ('0x' || substr(md5(word), 1, 8))::bigint % {language.SLOTS} as slot from tokens),
counts as (
  select slot, {sums} from slotted where not held_out and lang in ('en', 'fr', 'de', 'es') group by slot
),
weights as (select slot, {logs} from counts),
scores as (select doc_id, {totals} from slotted join weights p using (slot) group by doc_id)
select d.doc_id, substr(md5(d.doc_id::varchar), 1, 1) < '4' as held_out, case when s.doc_id is null then 'unknown'
  when en = {top} then 'en' when fr = {top} then 'fr' when de = {top} then 'de' else 'es' end as lang
from documents d left join scores s using (doc_id)
"""


@query(_sql_slots())
def detect_language_in_row(spark, sf_dir):
    """Languages without a shuffle of texts; a quarter of the documents, held out, teaches nothing."""
    held = F.substr(F.md5(F.col("doc_id").cast("string")), F.lit(1), F.lit(1)) < "4"
    documents = text_table(spark, sf_dir, "documents", "doc_id").withColumn("held_out", held)
    profile = language.fit_slots(documents.filter(~F.col("held_out")), "text", "lang", _LANGS, slot_of=language.md5_slot)
    found = language.language_in_row(documents.select("doc_id", "held_out", "text"), "text", profile, language.md5_slot)
    return found.drop("text")


@query(f"""
select doc_id, md5({sql_strip('text')}) as stripped, md5({sql_collapse('text')}) as collapsed,
  substr(text, 1, 120) as head, cast(length(text) as int) as n
from documents
""")
def text_basics(spark, sf_dir):
    value = F.col("text")
    return text_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        F.md5(text.strip(value)).alias("stripped"),
        F.md5(text.clean_extracted(value)).alias("collapsed"),
        text.prefix(value, 120).alias("head"),
        F.length(value).alias("n"),
    )
