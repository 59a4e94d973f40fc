"""Queries over tracks, targets, carried names, jobs and reports. The supplied data holds no such tables, so they are derived from
lineitem, orders and events by SQL that both engines read; the queries run the operators, their SQL says the same otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages as L
from ..operators import tracks as tk
from ..tables import SPANS, read, spans


def _pick(value: str, *options: str) -> str:
    return f"case {value} % {len(options)} " + " ".join(f"when {i} then {o}" for i, o in enumerate(options)) + " end"


_LANGS = ("'eng'", "'jpn'", "'fre'", "'ger'", "'tha'", "'kor'", "'und'", "'spa'", "'chi'", "'rus'", "'heb'", "'xxx'", "''", "cast(null as string)")
_TITLES = ("''", "'English'", "'SDH'", "'Signs & Songs'", "'Forced'", "'Commentary'", "'日本語'", "'Français'", "'Deutsch (CC)'", "'Hearing impaired'", "cast(null as string)")
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_FOUR = "(0, 'en'), (1, 'th'), (2, 'ja'), (3, 'fr')"
#: The derived tables.
TABLES = {
    "tracks": f"select l_orderkey as file, cast(row_number() over (partition by l_orderkey order by {_ORDER}) - 1 as int) as idx, {_pick('l_partkey', *_LANGS)} as language, {_pick('l_suppkey', *_TITLES)} as title, case when l_linenumber % 3 <> 0 then 'subrip' when l_partkey % 5 = 0 then 'dvd_subtitle' else 'hdmv_pgs_subtitle' end as codec, l_linenumber % 3 <> 0 as is_text, l_quantity <= 4 as forced, l_linenumber = 1 as is_default from lineitem",
    "audio": f"select l_orderkey as file, cast(row_number() over (partition by l_orderkey order by {_ORDER}) - 1 as int) as idx, {_pick('l_suppkey', *_LANGS[::2])} as language, {_pick('l_partkey', chr(39) * 2, _TITLES[6], repr('Japan mix'), repr('Director'), _TITLES[-1], repr('5.1'))} as title, l_linenumber = 2 as is_default from lineitem",
    "targets": f"select o_orderkey as file, target from orders cross join (values {_FOUR}) t(k, target) where (o_orderkey + k) % 3 <> 0",
    "outputs": f"select o_orderkey as file, target, o_orderkey * 37 % 300 as mtime from orders cross join (values {_FOUR}) t(k, target) where (o_orderkey + k) % 4 = 0",
    "spoken": f"select o_orderkey as file, {_pick('o_orderkey', repr('ja'), repr('en'), 'cast(null as string)', repr('ru'), repr('fr'))} as spoken from orders",
    "sidecars": f"select o_orderkey as file, {_pick('o_custkey', repr('en'), repr('ko'), repr('es'))} as code from orders where o_orderkey % 9 = 0",
    "wanted": f"select o_orderkey as file, {_pick('o_custkey', repr('th'), repr('he'), repr('de'), repr('vi'), repr('zz'))} as target, {_pick('o_orderkey', repr('en'), repr('ja'), 'cast(null as string)')} as source from orders",
    "rendered": f"select l_suppkey % 10 as series, {_pick('l_linenumber', repr('en'), repr('de'), repr('th'))} as target, concat('term', cast(l_partkey % 50 as string)) as term, {_pick('l_suppkey', *(repr('r' + str(i)) for i in range(6)), repr(''))} as rendering, l_orderkey as episode, l_linenumber * 1000000 + l_partkey as pos from lineitem",
    "fixed": f"select {_pick('l_linenumber', repr('en'), repr('de'), repr('th'))} as target, concat('term', cast(l_partkey % 50 as string)) as term, max(concat('own', cast(l_partkey % 50 as string))) as rendering from lineitem where l_partkey % 50 < 9 group by 1, 2",
    "skiplog": "select l_orderkey * 10000000 + l_partkey * 1000 + l_suppkey as line, concat('/v/', cast(l_partkey % 500 as string)) as path, l_returnflag as verdict from lineitem",
    "waves": "select o_orderkey as file, o_totalprice as wav, o_totalprice + (o_custkey % 9 - 4) * 0.5 as track from orders",
    "calls": "select concat('m', cast(l_suppkey % 9 as string)) as model, cast(l_quantity as bigint) as tokens, case when l_suppkey % 9 = 3 then cast(0 as double) else l_quantity * 0.25 end as seconds from lineitem",
    "cards": "select o_orderkey as card, o_custkey % 30 as gb from orders",
    "pages_found": f"select o_orderkey as file, {_pick('o_custkey', repr('The Long Film'), repr('Show of Five, Two'), repr('Solo'))} as title, 1990 + o_orderkey % 30 as year, {_pick('o_orderkey', repr('2001 film'), repr('album'), repr('TV series'), 'cast(null as string)')} as kind, {_pick('o_orderkey', repr('the long film (film)'), repr('Show of Five'), repr('solo'), repr('Other'))} as page_title, case when o_custkey % 11 = 0 then null else 1990 + o_custkey % 30 end as page_year from orders",
    "voices": f"select o_orderkey as file, concat({_pick('o_custkey', repr('S'), repr('S'), repr('X'))}, cast(o_custkey % 4 as string)) as tag, {_pick('o_orderkey', repr('Anna'), repr('BO'), repr('Nobody'))} as name, {_pick('o_custkey', repr('says so'), repr(' '), repr('x'), 'cast(null as string)')} as evidence from orders",
    "cast_names": f"select o_orderkey as file, {_pick('o_custkey', repr('anna'), repr('Bo'), repr('Cy'))} as name from orders",
    "asked": f"select distinct {_pick('l_linenumber', repr('en'), repr('de'), repr('th'))} as target, concat('term', cast(l_partkey % 40 as string)) as term from lineitem",
    "replies": f"select {_pick('l_linenumber', repr('en'), repr('de'), repr('th'))} as target, l_orderkey * 10000000 + l_partkey * 1000 + l_suppkey as n, concat('term', cast(l_partkey % 50 as string), {_pick('l_suppkey', 'chr(9)', repr(' → '), repr(' - '), repr(': '))}, {_pick('l_orderkey', repr('one'), repr('two - three'), repr(' '), repr('x' * 61), repr('vier'))}) as line from lineitem",
    "names": f"select o_orderkey as file, concat({_pick('o_orderkey', repr(''), repr('[Grp] '), repr(''))}, {_pick('o_custkey', repr('Show.Name'), repr('2001.A.Space'), repr('Plain'), repr('A Film'))}, {_pick('o_orderkey', repr('.S02E05.'), repr(' - 0064 [720p]'), repr('.1999.'), repr(' (2008) '), repr('.'), repr(' s1e2 - '), repr(' '))}, {_pick('o_custkey', repr('1080p.BluRay.x264'), repr(''), repr('WEB-DL.AAC'), repr('Extra'), repr('hdtv'))}) as name from orders",
    "sheet_replies": f"select o_orderkey as file, concat({_pick('o_custkey', repr('noise '), repr(''), repr('[1] '))}, {_pick('o_orderkey', repr('{\"name\":\"Anna\",\"gender\":\"f\",\"role\":\"a role that is very much longer than the forty characters kept\"} tail'), repr('{\"name\":\"Bo\"}'), repr('no object'), repr('{broken'))}) as reply from orders",
    "actions": f"select o_custkey as job, o_orderkey as n, {_pick('o_orderkey', *(repr(a) for a in ('start', 'pause', 'cancel', 'resume', 'stopped', 'retry', 'error', 'finished', 'requeue')))} as action from orders",
    "glossary_lines": "select * from (values ('en', 'Anna', 'Anna', 1), ('en', 'Bo', 'Beau', 1), ('de', 'Anna', 'Anne', 1), ('en', 'Anna', 'Ana', 2), ('en', 'Cy', 'Si', 2)) v(target, term, rendering, n)",
    "log": "select * from (values (1, '=== a.mkv'), (2, '[asr] 10%'), (3, '=== b.mkv'), (4, '[asr] 20%'), (5, '[asr] done'), (6, '=== a.mkv'), (7, '[translate] 50%')) v(n, line)",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sql = TABLES[name].replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")
    used = {t: read(spark, sf, t) for t in ("lineitem", "orders") if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(sql, **used)


def _of(name: str, run):
    return lambda spark, sf: run(table(spark, sf, name))


READABLE = ("ja", "zh", "ko", "en")


def _planned(spark, sf, **more):
    t = {n: table(spark, sf, n) for n in ("tracks", "targets", "spoken", "sidecars")}
    return tk.plan_sources(t["tracks"], t["targets"], t["spoken"], **({"sidecars": t["sidecars"], "readable": READABLE} | more))


def b16_check_source(spark, sf):
    heard = spans(spark, sf).groupBy("file_id", "lang").agg(F.sum(F.col("e") - F.col("s")).alias("sec"), F.min("pos").alias("first"))
    return tk.check_source(heard.withColumnRenamed("file_id", "file").withColumn("sec", F.round("sec", 3)), ("view", "click")).select("file", "dominant", "verdict")


ROUTES = "select * from (values ('ja', 'th', 'exact'), ('*', 'th', 'to-thai'), ('fr', '*', 'from-french'), ('*', '*', 'default')) v(src, tgt, preset)"
SIDES = "select distinct coalesce(source, 'fr') as src, target as tgt from wanted"


def _pairs(spark, sf):
    w = table(spark, sf, "wanted")
    return w.select(F.coalesce("source", F.lit("fr")).alias("src"), F.col("target").alias("tgt")).distinct()


def c23_merge_sheet(spark, sf):
    """Casts of series made of orders: names, aliases and relations by customer."""
    o = read(spark, sf, "orders").filter("o_custkey % 3 = 0")
    pick = lambda c, *xs: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sheet = o.select(c.alias("series"), k.alias("episode"), k.alias("pos"), pick(k, "Anna", "Bo", "Annie", "ボ", "Cy", "").alias("name"), pick(k, "", "ボ", "アンナ", "").alias("source_name"), F.array(pick(k, "Annie", "", "Si", "Ann")).alias("aliases"), pick(k, "?", "f", "m", "?", "?").alias("gender"), pick(k, "unknown", "20", "30").alias("age"), F.array(pick(k, "Bo:friend", "Anna:sister", ":none")).alias("relations"))
    return tk.merge_sheets(sheet)


QUERIES = {
    "a2_audio_pick": _of("audio", tk.audio_pick),
    "a12_glossary": _of("glossary_lines", lambda t: t.groupBy("target", "term").agg(F.max_by("rendering", "n").alias("rendering"))),
    "a14_skipped": _of("skiplog", tk.latest_verdicts),
    "a15_log_state": _of("log", lambda t: t.sparkSession.sql("select file, max_by(state, n) as state, count(*) as events from (select n, last(case when line like '=== %' then substr(line, 5) end, true) over (order by n rows unbounded preceding) as file, case when line like '[%' then line end as state from {t}) where state is not null group by file", t=t)),
    "b11_pick": _of("tracks", tk.pick),
    "b11_pick_bitmap": _of("tracks", tk.pick_bitmap),
    "b12_reference_tracks": _of("tracks", lambda t: tk.reference_tracks(t, assume="ja")),
    "b15_missing_targets": lambda s, sf: tk.missing_targets(table(s, sf, "targets"), table(s, sf, "outputs"), True, 100),
    "b16_check_source": b16_check_source,
    "b18_lookup_gate": _of("pages_found", lambda t: t.select("file", tk.lookup_verdict(*map(F.col, ("title", "year", "kind", "page_title", "page_year"))).alias("verdict"))),
    "b20_voice_gate": lambda s, sf: tk.voice_names(table(s, sf, "voices"), table(s, sf, "cast_names")).select("file", "tag", "name"),
    "b21_durations": _of("waves", lambda t: tk.off_duration(t).select("file")),
    "c17_route": lambda s, sf: tk.route(_pairs(s, sf), s.sql(ROUTES)),
    "c18_code_for_tag": _of("tracks", lambda t: t.select("file", "idx", tk.code_for_tag(F.col("language")).alias("code"))),
    "c21_evidence": lambda s, sf: tk.evidence_tracks(table(s, sf, "tracks"), table(s, sf, "wanted")),
    "c23_merge_sheet": c23_merge_sheet,
    "c24_merge_glossary": lambda s, sf: tk.carry_glossary(table(s, sf, "rendered"), table(s, sf, "fixed")),
    "c25_satisfied": lambda s, sf: _planned(s, sf)[0],
    "c25_source": lambda s, sf: _planned(s, sf)[1],
    "c25_bitmap_targets": lambda s, sf: tk.bitmap_targets(table(s, sf, "tracks"), table(s, sf, "targets"), READABLE),
    "d17_verdicts": _of("skiplog", lambda t: t.groupBy("verdict").agg(F.count("*").alias("n"))),
    "d18_usage": _of("calls", tk.usage),
    "d23_queue_depth": _of("actions", lambda t: tk.job_states(t).filter("state in ('queued', 'running')").agg(F.count("*").alias("depth"))),
    "g5_targets": lambda s, sf: _pairs(s, sf).union(s.sql(ROUTES).select("src", "tgt")).distinct(),
    "h15_is_sdh": _of("tracks", lambda t: t.select("file", "idx", F.coalesce("title", F.lit("")).rlike(r"(?i)sdh|hearing|\bcc\b|closed caption").alias("sdh"))),
    "h27_identify": _of("names", lambda t: t.select("file", tk.identify(F.col("name")).alias("x")).select("file", "x.*")),
    "h39_prompt": _of("fixed", tk.prompts),
    "h41_sheet": _of("sheet_replies", lambda t: t.select("file", tk.sheet_entry(F.col("reply")).alias("x")).select("file", "x.*")),
    "h42_profile": _of("cards", lambda t: t.select("card", tk.profile(F.col("gb")).alias("profile"))),
    "h43_facts": _of("pages_found", lambda t: t.select("file", tk.facts(F.col("title"), F.col("page_year"), F.col("kind")).alias("facts"))),
    "l_transitions": _of("actions", tk.job_states),
    "l_next_job": _of("actions", lambda t: tk.job_states(t).filter("state = 'queued'").orderBy("job").limit(1).select("job")),
    "m5_replies": lambda s, sf: tk.rendered_terms(table(s, sf, "replies"), table(s, sf, "asked")),
    "m7_source_order": _of("spoken", lambda t: t.select("file", "spoken", F.explode(F.array(*map(F.lit, ("ja", "ru", "th", "et")))).alias("code")).select("file", "code", tk.source_rank(F.col("code"), F.col("spoken")).alias("place"))),
    "m6_describe": _of("tracks", tk.describe),
    "m9_lookups": _of("wanted", lambda t: t.select("file", tk.language_name(F.col("target")).alias("name"), tk.subtitle_path(F.concat(F.lit("/v.1/film "), F.col("file").cast("string"), F.lit(".mkv")), F.col("target")).alias("path"), tk.has_japanese(F.when(F.col("file") % 3 == 0, "x日").otherwise("xyz")).alias("japanese"))),
    "m13_missing": _of("tracks", lambda t: t.filter(tk.code_for_tag(F.col("language")).isNull()).select(F.coalesce("language", F.lit("")).alias("language")).distinct()),
}

_VALUES = lambda rows: ", ".join("(" + ", ".join(f"{x}" if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
# Reference tables for DuckDB.
_TAGS = "tags(code, tag, k) as (values " + _VALUES([(c, t, i) for i, c in enumerate(L.NAMES) for t in L.tags(c)]) + ")"
_WORDS = "title_words(code, word) as (values " + _VALUES([(c, w) for c in L.NAMES for w in L.title_words(c)]) + ")"
_MARKS = "marks(code, mark, rank) as (values " + _VALUES([(c, m, L.READ_BEST.index(c)) for c, v in L.MARKS.items() for m in v.split()]) + ")"
_NEEDS = "needs(target, need, k) as (values " + _VALUES([(c, n, i) for c, v in L.NEEDS.items() for i, n in enumerate(sorted(v.split()))]) + ")"
_EQUAL = "equal(need, mark) as (values " + _VALUES([(k, m) for k, v in L.STANDS_FOR.items() for m in v]) + ")"
_ORDERED = "ordered(code, place) as (values " + _VALUES([(c, i + 1) for i, c in enumerate([*L.SOURCES_FIRST, *(x for x in L.NAMES if x not in L.SOURCES_FIRST)])]) + ")"
_NAMES_OF = "names_of(code, name) as (values " + _VALUES(list(L.NAMES.items())) + ")"
_CODE = "tag_code as (select tag, arg_min(code, k) as code from tags group by tag)"
_SERVED = """served as (select distinct t.*, x.code from tracks t join (select code, tag as v, true as is_tag from tags union all select code, word, false from title_words) x
  on case when is_tag then coalesce(t.language, '') = v else contains(lower(coalesce(t.title, '')), v) end
  where not coalesce(forced, false) and not regexp_matches(coalesce(title, ''), '(?i)sign|song|forced|commentary|karaoke|lyric|caption only'))"""
_PICK = "pick as (select file, code, min(idx) as idx from served where is_text group by all)"
_BITMAP = "pick_bitmap as (select file, code, arg_min(idx, case when regexp_matches(coalesce(title, ''), '(?i)sdh|hearing|cc\\b') then 1000 else 0 end + idx) as idx from served where not is_text and codec = 'hdmv_pgs_subtitle' group by all)"
_REMAINING = "satisfied as (select file, target from targets where exists (select 1 from pick p where p.file = targets.file and p.code = target)), remaining as (select file, target from targets except select * from satisfied)"
_OFFERS = "offers as (select file, code, 0 as kind, idx from pick union all select file, code, 1, null from sidecars union all select file, code, 2, idx from pick_bitmap where code in ('ja', 'zh', 'ko', 'en'))"
_MOVES = "moves(state, action, next) as (values " + _VALUES([(s, a, t) for (s, a), t in tk.MOVES.items()]) + ")"
_STATES = """numbered as (select job, action, row_number() over (partition by job order by n, action) as k from actions),
walk as (select job, 'queued' as state, 0 as moved, 0 as k from (select distinct job from actions) union all
  select w.job, coalesce(m.next, w.state), w.moved + cast(m.next is not null as int), w.k + 1 from walk w join numbered a on a.job = w.job and a.k = w.k + 1 left join moves m on m.state = w.state and m.action = a.action),
states as (select job, arg_max(state, k) as state, cast(max(moved) as int) as moved from walk group by job)"""
_BARE = r"regexp_replace(name, '^\[[^\]]+\]\s*', '')"
_F, _E, _Y = (p.replace("'", "''") for p in (tk.FANSUB, tk.EPISODE, tk.YEAR))
ORACLES = {
    "a2_audio_pick": ("select file, idx, case when c = 'ja' then 'tag' when jt then 'title' when n = 1 then 'only' when is_default then 'default' else 'first' end as reason from (select a.*, tag_code.code as c, regexp_matches(coalesce(title, ''), '(?i)日本|japan') as jt, count(*) over (partition by file) as n from audio a left join tag_code on tag = lower(trim(coalesce(language, '')))) window f as (partition by file) qualify idx = coalesce(min(idx) filter (c = 'ja') over f, min(idx) filter (jt) over f, min(idx) filter (is_default) over f, 0)", _TAGS, _CODE),
    "a12_glossary": ("select target, term, rendering from glossary_lines g where not exists (select 1 from glossary_lines h where h.target = g.target and h.term = g.term and h.n > g.n)",),
    "a14_skipped": ("select path, verdict, (select count(*) from skiplog c where c.path = s.path) as n from (select distinct on (path) * from skiplog order by path, line desc, verdict desc) s",),
    "a15_log_state": ("select file, arg_max(state, n) as state, count(*) as events from (select n, last_value(case when line like '=== %' then substr(line, 5) end ignore nulls) over (order by n rows unbounded preceding) as file, case when line like '[%' then line end as state from log) t where state is not null group by file",),
    "b11_pick": ("select * from pick", _TAGS, _WORDS, _SERVED, _PICK),
    "b11_pick_bitmap": ("select * from pick_bitmap", _TAGS, _WORDS, _SERVED, _BITMAP),
    "b12_reference_tracks": ("select file, idx, case when tag_code.code is not null then tag_code.code when trim(coalesce(language, '')) in ('und', '', 'mis', 'zxx') then 'ja' end as code from tracks left join tag_code on tag = lower(trim(language)) where is_text and not forced and not regexp_matches(coalesce(title, ''), '(?i)sdh|commentary|signs|forced') and (tag_code.code is not null or coalesce(language, '') in ('und', ''))", _TAGS, _CODE),
    "b15_missing_targets": ("select file, target from targets except select file, target from outputs where mtime >= 100",),
    "b16_check_source": ("select file_id as file, dominant, case when dominant in ('view', 'click') then 'ok' else 'unsupported' end as verdict from (select file_id, arg_min(lang, (-sec, first)) as dominant from (select file_id, lang, round(sum(e - s), 3) as sec, min(pos) as first from spans group by all) group by file_id)", SPANS),
    "b18_lookup_gate": ("select file, case when not coalesce(regexp_matches(kind, '(?i)film|movie|series|episode|show'), false) then 'kind' when len(list_intersect(w, p)) / len(list_distinct(w)) < 0.6 then 'title' when abs(year - page_year) > 1 then 'year' else 'ok' end as verdict from (select *, regexp_extract_all(lower(title), '[a-z0-9]+') as w, regexp_extract_all(lower(page_title), '[a-z0-9]+') as p from pages_found)",),
    "b20_voice_gate": ("select file, tag, name from voices v where regexp_full_match(tag, 'S[0-9]+') and trim(evidence) <> '' and lower(name) in (select lower(c.name) from cast_names c where c.file = v.file)",),
    "b21_durations": ("select file from waves where not (wav - track between -1 and 1)",),
    "c17_route": (f"select src, tgt, coalesce((select preset from r where r.src = p.src and r.tgt = p.tgt), (select preset from r where r.src = '*' and r.tgt = p.tgt), (select preset from r where r.src = p.src and r.tgt = '*'), 'default') as preset from p", f"r as ({ROUTES})", f"p as ({SIDES})"),
    "c18_code_for_tag": ("select file, idx, code from tracks left join tag_code on tag = lower(trim(language))", _TAGS, _CODE),
    "c21_evidence": ("""select file, target, cast(0 as int) as place, idx1 as idx from two where idx1 is not null union all select file, target, cast(case when idx1 is null then 0 else 1 end as int), idx2 from two where idx2 is not null""",
        _TAGS, _CODE, _MARKS, _NEEDS, _EQUAL,
        """offer as (select w.file, w.target, t.idx, c.code, m.mark, m.rank from wanted w join tracks t on t.file = w.file and is_text and not regexp_matches(coalesce(title, ''), '(?i)sdh|forced|commentary') join tag_code c on c.tag = lower(trim(language)) join marks m on m.code = c.code where c.code <> w.target and c.code <> coalesce(w.source, ''))""",
        """one as (select w.file, w.target, (select arg_min(idx, rank * 1000 + idx) from offer o join equal e on e.mark = o.mark join needs n on n.need = e.need and n.target = w.target and n.k = 0 where o.file = w.file and o.target = w.target) as idx1 from wanted w where w.target in (select target from needs))""",
        """two as (select one.*, (select arg_min(o.idx, o.rank * 1000 + o.idx) from offer o join equal e on e.mark = o.mark join needs n on n.need = e.need and n.target = one.target and n.k = 1 where o.file = one.file and o.target = one.target and o.idx is distinct from one.idx1 and not exists (select 1 from offer x where x.file = one.file and x.target = one.target and x.idx = one.idx1 and x.mark = n.need)) as idx2 from one)"""),
    "c24_merge_glossary": ("select series, r.target, r.term, coalesce(f.rendering, r.rendering) as rendering from (select distinct on (series, target, term) * from rendered where rendering <> '' order by series, target, term, episode, pos, rendering) r left join fixed f on f.target = r.target and f.term = r.term",),
    "c25_satisfied": ("select * from satisfied", _TAGS, _WORDS, _SERVED, _PICK, _REMAINING),
    "c25_source": ("select distinct on (file) file, code, ['text', 'side', 'bitmap'][kind + 1] as kind, idx from offers o join ordered using (code) left join spoken s using (file) where exists (select 1 from remaining r where r.file = o.file) and not exists (select 1 from remaining r where r.file = o.file and r.target = o.code) order by file, o.kind, case when code = spoken then 0 else place end", _TAGS, _WORDS, _SERVED, _PICK, _BITMAP, _REMAINING, _OFFERS, _ORDERED),
    "c25_bitmap_targets": ("select t.file, t.target, b.idx from targets t join pick_bitmap b on b.file = t.file and b.code = t.target left join pick p on p.file = t.file and p.code = t.target where p.file is null and t.target in ('ja', 'zh', 'ko', 'en')", _TAGS, _WORDS, _SERVED, _PICK, _BITMAP),
    "d17_verdicts": ("select verdict, sum(1)::bigint as n from skiplog group by verdict",),
    "d18_usage": ("select model, cast(sum(tokens) as bigint) as tokens, case when sum(seconds) > 0 then sum(tokens) / sum(seconds) end as per_second from calls group by model",),
    "d23_queue_depth": ("select count(*) as depth from states where state in ('queued', 'running')", _MOVES, _STATES),
    "g5_targets": (f"select * from p union select src, tgt from r", f"r as ({ROUTES})", f"p as ({SIDES})"),
    "h15_is_sdh": ("select file, idx, coalesce(contains(lower(title), 'sdh') or contains(lower(title), 'hearing') or contains(lower(title), 'closed caption') or list_contains(regexp_split_to_array(lower(title), '[^a-z0-9_]+'), 'cc'), false) as sdh from tracks",),
    "h27_identify": (f"select file, case when f or e then 'episode' else 'film' end as kind, trim(regexp_replace(case when f then trim(regexp_extract(name, '{_F}', 1)) when e then trim(regexp_replace(regexp_extract(b, '{_E}', 1), '[._]+', ' ', 'g'), ' -') when y then trim(regexp_replace(regexp_extract(b, '{_Y}', 1), '[._]+', ' ', 'g'), ' -(') else regexp_replace(b, '[._]+', ' ', 'g') end, '{tk.RELEASE}', ''), ' -') as title, case when y and not e and not f then cast(regexp_extract(b, '{_Y}', 2) as int) end as year, case when e and not f then cast(regexp_extract(b, '{_E}', 2) as int) end as season, case when f then cast(regexp_extract(name, '{_F}', 2) as int) when e then cast(regexp_extract(b, '{_E}', 3) as int) end as episode, case when f or e or y then 0.8 else 0.4 end::double as confidence from (select *, regexp_matches(name, '{_F}') as f, regexp_matches(b, '{_E}') as e, regexp_matches(b, '{_Y}') as y from (select *, {_BARE} as b from names))",),
    "h39_prompt": ("select target, 'Use: ' || array_to_string(list_sort(list(term || ' = ' || rendering))[:60], '; ') as prompt from fixed group by target",),
    "h41_sheet": ("select file, name, case when ok then coalesce(gender, '?') else '?' end as gender, role from (select file, ok, case when ok then json_extract_string(o, '$.name') end as name, case when ok then json_extract_string(o, '$.gender') end as gender, case when ok then left(json_extract_string(o, '$.role'), 40) end as role from (select file, o, json_valid(o) and o <> '' as ok from (select file, regexp_extract(reply, '(?s)(\\{.*\\})', 1) as o from sheet_replies)))",),
    "h42_profile": ("select card, coalesce((select name from (values (20, 99, 'full'), (14, 19, '16gb'), (10, 13, '12gb'), (7, 9, '8gb')) p(lo, hi, name) where gb between lo and hi), 'none') as profile from cards",),
    "h43_facts": ("select file, title || coalesce(' (' || page_year || ')', '') || coalesce(': ' || kind, '') as facts from pages_found",),
    "l_transitions": ("select * from states", _MOVES, _STATES),
    "l_next_job": ("select min(job) as job from states where state = 'queued' having count(*) > 0", _MOVES, _STATES),
    "m5_replies": ("select target, term, arg_max(r, n) as rendering from (select target, n, trim(left(line, here - 1)) as term, trim(substr(line, here + length(sep))) as r from (select *, strpos(line, sep) as here from (select *, case when contains(line, chr(9)) then chr(9) when contains(line, '→') then '→' when contains(line, ' - ') then ' - ' end as sep from replies)) where here > 0) semi join asked using (target, term) where length(r) between 1 and 60 group by all",),
    "m7_source_order": ("select file, code, case when code = spoken then 0 else place end::int as place from spoken cross join (select * from ordered where code in ('ja', 'ru', 'th', 'et'))", _ORDERED),
    "m6_describe": ("select file, string_agg(printf('#%d %s%s %s%s', idx, coalesce(n.name, 'unknown'), case when coalesce(title, '') <> '' then ' ' || chr(39) || title || chr(39) else '' end, codec, case when forced or is_default or not is_text then ' [' || array_to_string(list_filter([case when forced then 'forced' end, case when is_default then 'default' end, case when not is_text then 'bitmap' end], lambda x: x is not null), ', ') || ']' else '' end), chr(10) order by idx) as text from tracks left join tag_code on tag = lower(trim(language)) left join names_of n using (code) group by file", _TAGS, _CODE, _NAMES_OF),
    "m9_lookups": ("select file, coalesce((select n.name from names_of n where n.code = w.target), target) as name, '/v.1/film ' || file || '.' || target || '.srt' as path, file % 3 = 0 as japanese from wanted w", _NAMES_OF),
    "m13_missing": ("select distinct coalesce(language, '') as language from tracks where coalesce(language, '') not in (select tag from tags)", _TAGS),
}


def _sql(body: str, *ctes: str) -> str:
    import re

    text = body + " ".join(ctes)
    used = [f"{t} as ({TABLES[t].replace(' as string)', ' as varchar)')})" for t in TABLES if re.search(rf"\b{t}\b", text)]
    return "with recursive " + ",\n".join([*used, *ctes]) + "\n" + body


SQL = {k: _sql(*v) for k, v in ORACLES.items()}
