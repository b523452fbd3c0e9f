"""DuckDB statements that compute the same answers as ``registry.py`` from the same
Parquet tables (views ``documents``, ``conversations``, ``pages``, ``events``,
``customer``, ``orders``).  Written independently as plain SQL with windows; the
same fixed values and perturbations are spliced in from ``config`` / ``registry``."""
from __future__ import annotations

from .. import config as C
from ..operators.layout import BAD_CHARACTER, NO_CONTENT
from ..operators.translate import LetterModel
from ..streaming import job_timers
from ..streaming.stream import SILENT, TIMER_DELAY_DAYS
from .registry import EXTRA, FILE_LIMITS, JOB_OPTIONS, LANG, LANG_NAMES, LIMIT_OVERRIDES, OTHER_FORMAT, OTHER_LANG, WAVE

WS = "||".join(f"chr({ord(c)})" for c in C.WHITESPACE)
NL2 = "chr(10)||chr(10)"
SQL: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def blank(x: str) -> str:
    return f"(length({strip(x)}) = 0)"


def esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def mock(x: str, lang: str = LANG) -> str:
    return (f"(case when length({x}) = 0 then '' else {q(C.MOCK_TEXT_PREFIX + lang + ': ')} "
            f"|| substring({x}, 1, {C.MOCK_TEXT_PREVIEW}) || '...' end)")


def letters(x: str, lang: str = LANG) -> str:
    return f"({q('[' + lang + '] ')} || translate({x}, {q(LetterModel.FROM)}, {q(LetterModel.TO)}))"


def coded(x: str) -> str:
    return f"coalesce(length(cast({x} as varchar)) || ':' || cast({x} as varchar), 'n')"


def job_id(intake: str, book: str, submission: str = q("0"), lang: str = q(LANG), fmt: str = q("docx")) -> str:
    return "md5(" + " || ".join(coded(x) for x in (q(intake), book, lang, fmt, submission)) + ")"


def fixed_decimal_py(n: int, den: int, d: int) -> str:
    scale = 10 ** d
    num = n * scale
    qq, r = divmod(num, den)
    if 2 * r > den or (2 * r == den and qq % 2 == 1):
        qq += 1
    return f"{qq // scale}.{qq % scale:0{d}d}" if d else str(qq)


def fixed_decimal(x: str, den: int, d: int) -> str:
    scale = 10 ** d
    num = f"(cast({x} as bigint) * {scale})"
    qq = (f"(({num} // {den}) + case when ({num} % {den}) * 2 > {den} then 1 "
          f"when ({num} % {den}) * 2 = {den} and ({num} // {den}) % 2 = 1 then 1 else 0 end)")
    return f"(cast({qq} // {scale} as varchar) || '.' || lpad(cast({qq} % {scale} as varchar), {d}, '0'))"


DOC_CH = "select source as book_id, doc_id as id, doc_id as ordinal, text as content, lang from documents"
CONV_CH = ("select conv_id as book_id, turn + 1 as id, turn as ordinal, text as content, role "
           "from conversations")


def blanked(src: str, every: int = 7, b: str | None = "  ") -> str:
    content = "cast(null as varchar)" if b is None else q(b)
    return (f"select * from ({src}) union all select * replace (id + {EXTRA} as id, ordinal + {EXTRA} as ordinal, "
            f"{content} as content) from ({src}) where id % {every} = 0")


def paragraphed(src: str) -> str:
    return (f"select * replace (replace(content, chr(10), {NL2}) || case when id % 5 = 0 "
            f"then {NL2}||' ' else '' end as content) from ({src})")


def slices(src: str, width: int, cap: int | None = None, keep_empty: bool = False) -> str:
    n = f"cast(ceil(length(content) / {width}.0) as bigint)"
    if keep_empty:
        n = f"greatest({n}, 1)"
    if cap is not None:
        n = f"least({n}, {cap})"
    return (f"select *, cast(i as integer) as idx, substring(content, i * {width} + 1, {width}) as piece "
            f"from (select *, unnest(range(0, {n})) as i from ({src}))")


def pos(src: str, width: int = C.CHARS_PER_PAGE) -> str:
    return (f"select *, cast(row_number() over (partition by book_id order by id, ordinal) - 1 as integer) "
            f"as ch_idx, count(*) over (partition by book_id) as n_chapters, "
            f"cast(coalesce(ceil(length(content) / {width}.0), 0) as integer) as n_pages from ({src})")


def page_rows(src: str) -> str:
    """CTE text for ``pos`` and ``pages`` over chapter source ``src``."""
    return f"""pos as ({pos(src)}),
pg as (select *, unnest(range(0, n_pages)) as j from pos),
pages as (select book_id, id, ordinal, ch_idx, n_chapters, n_pages, cast(j as integer) as page_idx,
  substring(content, j * 3000 + 1, 3000) as text,
  row_number() over (partition by book_id order by id, ordinal, j) as page_no from pg)"""


ALIGN = "case when page_no % 2 = 0 then 'LEFT' else 'RIGHT' end"
HAS_BREAK = "(page_idx < n_pages - 1 or ch_idx < n_chapters - 1)"


def title(x: str) -> str:
    return f"({q(C.TITLE_PREFIX)} || cast({x} as varchar))"


def docx_ctes(src: str) -> str:
    return f"""{page_rows(src)},
dels as (
  select book_id, ch_idx, -1 as j, 0 as rk, 'title' as kind, id as chapter_id, NULL::INTEGER as part_idx,
         {title('id')} as text, NULL::BIGINT as page_no, 'RIGHT' as align from pos
  union all
  select book_id, ch_idx, 0, 0, 'dropcap', id, page_idx, substring(text, 1, 1), NULL, NULL from pages where page_idx = 0
  union all
  select book_id, ch_idx, page_idx, 1, 'body', id, page_idx,
         case when page_idx = 0 then substring(text, 2) else text end, NULL, NULL from pages
  union all
  select book_id, ch_idx, page_idx, 2, 'number', id, page_idx, cast(page_no as varchar), page_no,
         {ALIGN} from pages
  union all
  select book_id, ch_idx, page_idx, 3, 'break', id, page_idx, NULL, NULL, NULL from pages
  where {HAS_BREAK}),
docx as (select book_id, row_number() over (partition by book_id order by ch_idx, j, rk) as seq, kind,
  chapter_id, part_idx, text, page_no, align, NULL::DOUBLE as height_in from dels)"""


NOT_XML = r"regexp_matches(content, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]')"


def pdf_ctes(src: str) -> str:
    return f"""ppos as ({pos(src)}),
paras as (select book_id, id, ordinal, ch_idx, unnest(string_split(content, {NL2})) as para,
  unnest(range(0, len(string_split(content, {NL2})))) as i from ppos where not {NOT_XML}),
nb as (select * from paras where not {blank('para')}),
pels as (
  select book_id, ch_idx, -1 as i, 0 as rk, 'break' as kind, id as chapter_id, NULL::INTEGER as part_idx,
         NULL::VARCHAR as text, NULL::DOUBLE as height_in, NULL::VARCHAR as element_error from ppos where ch_idx > 0
  union all select book_id, ch_idx, -1, 1, 'title', id, NULL, {title('id')}, NULL,
         case when content is null then {q(NO_CONTENT)} when {NOT_XML} then {q(BAD_CHARACTER)} end from ppos
  union all select book_id, ch_idx, -1, 2, 'spacer', id, NULL, NULL, {C.TITLE_SPACER_IN}, NULL from ppos
  union all select book_id, ch_idx, i, 3, 'body', id, cast(i as integer), {esc('para')}, NULL, NULL from nb
  union all select book_id, ch_idx, i, 4, 'gap', id, cast(i as integer), NULL, {C.PARAGRAPH_SPACER_IN}, NULL
  from nb),
pdf as (select book_id, row_number() over (partition by book_id order by ch_idx, i, rk) as seq, kind,
  chapter_id, part_idx, text, NULL::BIGINT as page_no,
  case when kind = 'title' then 'RIGHT' end as align, height_in, element_error from pels)"""


def chunks(src: str) -> str:
    return f"select book_id, id, ordinal, idx as chunk_idx, piece as chunk, * exclude (book_id, id, ordinal, idx, piece, i, content) from ({slices(src, C.CHUNK_SIZE, keep_empty=True)})"


def mock_translated(src: str, lang: str = LANG) -> str:
    return (f"select *, case when {blank('chunk')} then '' else {strip(letters('chunk', lang))} end as translated, "
            f"cast(case when {blank('chunk')} then 0 else 1 end as integer) as attempts, "
            f"cast(0 as bigint) as wait_s, false as failed from ({chunks(src)})")


def reassembled(tr: str, text: str = "translated", carry: str = "") -> str:
    return (f"select book_id, ordinal, id{carry}, string_agg({text}, chr(10) order by chunk_idx) as content "
            f"from ({tr}) group by all")


def flaky(src: str, key: str) -> str:
    """Chunks through a model failing the first key % 6 attempts, 3 retries."""
    k = f"({key} % 6)"
    err = q(C.RETRY_ERROR.format(n=C.MAX_RETRIES, e="injected failure on attempt 4"))
    return f"""select *,
  case when {blank('chunk')} then '' when {k} <= 3 then {strip(letters('chunk'))} end as translated,
  cast(case when {blank('chunk')} then 0 when {k} <= 3 then {k} + 1 else 4 end as integer) as attempts,
  cast(case when {blank('chunk')} or {k} = 0 then 0 when {k} = 1 then 2 when {k} = 2 then 6 else 14 end
       as bigint) as wait_s,
  case when not {blank('chunk')} and {k} >= 4 then {err} end as error
from ({chunks(src)})"""


def job_events_sql() -> str:
    st = ("case event_type when 'signup' then 'queued' when 'view' then 'translating' when 'click' "
          "then 'formatting' when 'purchase' then 'completed' when 'error' then 'error' end")
    prog = " ".join(f"when {q(k)} then {v}" for k, v in C.PROGRESS.items())
    msgs = {C.STATUS_QUEUED: C.MSG_QUEUED, C.STATUS_TRANSLATING: C.MSG_TRANSLATING,
            C.STATUS_FORMATTING: C.MSG_FORMATTING, C.STATUS_COMPLETED: C.MSG_COMPLETED}
    msg = " ".join(f"when {q(k)} then {q(v)}" for k, v in msgs.items())
    return f"""select user_id as job_id, event_id, ts, status,
  cast(case status {prog} end as double) as progress,
  case when status = 'error' then {q(C.MSG_ERROR_PREFIX)} || props else case status {msg} end end as message,
  case when status = 'completed' then 'output/' || cast(user_id as varchar) || '.' ||
       case when value > 50 then 'pdf' else 'docx' end end as file_path,
  case when status = 'translating' then cast(json_extract_string(props, '$.k') as integer) end as current_chapter,
  case when status = 'queued' then cast(json_extract_string(props, '$.k') as integer) end as total_chapters,
  value, event_type
from (select *, {st} as status from events)"""


STATE = f"""ev as ({job_events_sql()}),
f as (select job_id, status, message, event_id,
  last_value(progress ignore nulls) over w as lp, last_value(file_path ignore nulls) over w as lf,
  last_value(total_chapters ignore nulls) over w as lt, last_value(current_chapter ignore nulls) over w as lc, count(*) over (partition by job_id) as n_events,
  row_number() over (partition by job_id order by ts desc, event_id desc) as rn
  from ev window w as (partition by job_id order by ts, event_id
                       rows between unbounded preceding and unbounded following)),
state as (select job_id, status, message, event_id as last_event_id, coalesce(lp, 0.0) as progress,
  lf as file_path, cast(coalesce(lc, 0) as integer) as current_chapter, cast(coalesce(lt, 0) as integer) as total_chapters,
  n_events from f where rn = 1)"""

PROBES = "probes as (select c_custkey as job_id from customer)"
LISTING = ("listing as (select distinct 'output/' || cast(o_custkey as varchar) || '.' || "
           "case when o_orderstatus = 'O' then 'pdf' else 'docx' end as path from orders)")

PAGE_FILES = f"""pf as (select page_id as file, url as name,
  case when page_id % 3 <> 0 then {q(C.PDF_CONTENT_TYPE)} else 'text/html' end as content_type,
  cast(strlen(html) as bigint) as length, html as text from pages)"""
PAGE_LINES = """pl as (select file, unnest(string_split(text, chr(10))) as line,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) as id from pf)"""


def too_large(mx: int) -> str:
    return q(C.REJECT_TOO_LARGE.format(mb=fixed_decimal_py(mx, 1048576, 1)))


def limits_of(x: str, what: int, default: int) -> str:
    """The tenant's override (column ``what`` of LIMIT_OVERRIDES), else the default."""
    own = " ".join(f"when {q(r[0])} then {r[what]}" for r in LIMIT_OVERRIDES if r[what] is not None)
    return f"(case {x} {own} else {default} end)"


def file_checks() -> str:
    a, rest = C.REJECT_TOO_MANY_PAGES.split("{n}")
    b, c = rest.split("{max}")
    sizes = {FILE_LIMITS.max_file_size} | {r[1] for r in LIMIT_OVERRIDES if r[1]}
    large = "case mx " + " ".join(f"when {m} then {too_large(m)}" for m in sorted(sizes)) + " end"
    return f"""{PAGE_FILES}, {PAGE_LINES},
np as (select file, count(*) filter (where not {blank('line')}) as n_pages from pl group by file),
lf as (select *, {limits_of("'src' || file % 20", 1, FILE_LIMITS.max_file_size)} as mx,
  {limits_of("'src' || file % 20", 2, FILE_LIMITS.max_chapters)} as mc from pf),
fc as (select lf.*, coalesce(np.n_pages, 0) as n_pages,
  case when content_type is distinct from {q(C.PDF_CONTENT_TYPE)} then {q(C.REJECT_NOT_PDF)}
       when length > mx then {large}
       when file % 5 = 0 and strlen(text) <> length(text) then {q(C.REJECT_EXTRACT_ERROR.format(e='not ASCII'))}
       when coalesce(np.n_pages, 0) = 0 then {q(C.REJECT_NO_TEXT)}
       when np.n_pages > mc then {q(a)} || cast(np.n_pages as varchar) || {q(b)} || mc || {q(c)}
  end as reject_reason
  from lf left join np using (file))"""


def jobs_both() -> str:
    return f"""{PAGE_FILES}, {PAGE_LINES},
books as (select source as book_id, count(*) as n from documents group by 1),
fbooks as (select cast(file as varchar) as book_id, count(*) as n from pl where not {blank('line')} group by 1),
jobs as (
  select {job_id('chapters', 'book_id')} as job_id, book_id,
         'chapters' as intake, {q(C.STATUS_QUEUED)} as status, 0.0::DOUBLE as progress,
         cast(0 as integer) as current_chapter, cast(n as integer) as total_chapters,
         {q(C.MSG_QUEUED)} as message, {q(LANG)} as target_language, 'docx' as output_format from books
  union all
  select {job_id('files', 'book_id')}, book_id, 'files', {q(C.STATUS_PENDING)},
         0.0, 0, cast(n as integer), {q(C.MSG_PENDING)}, NULL, NULL from fbooks)"""


# --- A ---------------------------------------------------------------------------------
SQL["scan_book_requests"] = f"""select cast(book_id as varchar) as book_id, id, ordinal, content,
  {q(LANG)} as target_language, cast(null as varchar) as output_format from ({CONV_CH})
union all select cast(book_id as varchar), id, ordinal, content, {q(OTHER_LANG)}, {q(OTHER_FORMAT)} from ({CONV_CH})
where book_id % 4 = 0"""
_BOOKS = "b as (select conv_id, count(*) as n from conversations group by conv_id)"
_LINES = """lines as (
  select cast(conv_id as varchar) as book_id, turn // 3 as part, conv_id from conversations group by all
  union all select cast(conv_id as varchar), null, conv_id from b where conv_id % 4 = 0)"""
SQL["schema_check"] = f"""with {_BOOKS}, {_LINES}
select book_id, part, cast(null as varchar) as schema_error from lines
union all select book_id, part, null from lines where conv_id % 3 = 0
union all select 'empty-' || conv_id, null, null from b where conv_id % 9 = 0
union all select 'silent-' || conv_id, null, 'field required: target_language' from b where conv_id % 9 = 1
union all select 'typed-' || conv_id, null, 'malformed request' from b where conv_id % 9 = 2"""
SQL["empty_request"] = f"""with {_BOOKS}, {_LINES},
l as (select book_id, part, case when part is null then {q(OTHER_LANG)} else {q(LANG)} end as target_language, n
  from lines join b using (conv_id)
  union all select 'empty-' || conv_id, null, {q(LANG)}, 0 from b where conv_id % 9 = 0)
select book_id, part, target_language, n as n_chapters, case when n = 0 then {q(C.REJECT_NO_CHAPTERS)}
  when n > 5 then {q(C.REJECT_TOO_MANY_CHAPTERS.format(max=5))} end as reject_reason from l"""
SQL["extract_errors"] = f"""with l as (select page_id, strlen(html) <> length(html) as failed,
  unnest(string_split(html || chr(10), chr(10))) as line from pages)
select page_id as file, cast(case when bool_or(failed) then 0 else count(*) filter (where not {blank('line')}) end
  as bigint) as n_pages, bool_or(failed) as failed from l group by page_id"""
SQL["scan_files"] = ("select page_id as file, cast(strlen(html) + 1 as bigint) as length, "
                     "strlen(html) + 1 <= 4000 as within_limit from pages")
SQL["extract_pages"] = f"""with {PAGE_LINES.replace('pl as', 'x as').replace('from pf', 'from (select id as file, content as text from (' + paragraphed(DOC_CH) + '))')}
select file, cast(id as bigint) as id, line as content from x where not {blank('line')}"""
SQL["job_events"] = f"""select job_id, event_id, status, progress, message, file_path, total_chapters,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts_text from ({job_events_sql()})"""
_ov = ", ".join(
    f"({q(t)}, {'NULL' if a is None else a}, {'NULL' if b is None else b}, {'NULL' if c is None else str(c).lower()})"
    for t, a, b, c in LIMIT_OVERRIDES)
SQL["limits_resolved"] = f"""with ov(tenant, mfs, mc, bg) as (values {_ov}),
t as (select distinct source as tenant from documents)
select tenant, cast(coalesce(mfs, {C.MAX_FILE_SIZE}) as bigint) as max_file_size,
  cast(coalesce(mc, {C.MAX_CHAPTERS}) as integer) as max_chapters,
  coalesce(bg, {str(C.USE_BACKGROUND_TASKS).lower()}) as use_background_tasks
from t left join ov using (tenant)"""

# --- B ---------------------------------------------------------------------------------
_JOBID_CONV = job_id("chapters", "book_id")
SQL["artifact_roundtrip"] = f"""with ch as ({CONV_CH}), {docx_ctes('ch')}
select {_JOBID_CONV} as job_id, seq, kind, case when book_id % 3 = 0 then 'v2 ' || text else text end as text
from docx"""
SQL["submission_response"] = f"""with {jobs_both()}
select job_id, book_id, intake, case when intake = 'chapters' then 200 else 202 end as http_status,
  '{{"job_id":"' || job_id || '","status":"' || status || '","message":"' ||
  case when intake = 'chapters' then {q(C.MSG_SUBMITTED)} else {q(C.MSG_PENDING)} end ||
  '","file_url":"{C.STATUS_URL_PREFIX}' || job_id || '"' ||
  case when intake = 'files' then ',"chapters_extracted":' || cast(total_chapters as varchar) else '' end
  || '}}' as body
from jobs"""
SQL["rejects"] = f"with {file_checks()} select file, reject_reason from fc where reject_reason is not null"

# --- C ---------------------------------------------------------------------------------
SQL["chapters_projected"] = f"select book_id, id, content from ({DOC_CH})"
SQL["file_type_filter"] = (f"with {PAGE_FILES} select file, content_type, "
                           f"coalesce(content_type = {q(C.PDF_CONTENT_TYPE)}, false) as accepted from pf")
SQL["size_filter"] = (f"with {PAGE_FILES} select file, length, length <= 4000 as accepted, "
                      f"case when length > 4000 then {too_large(4000)} end as reject_reason from pf")
SQL["empty_extraction"] = f"""with d as ({blanked(DOC_CH)}),
l as (select id as file, unnest(string_split(content, chr(10))) as line from d),
n as (select file, count(*) filter (where not {blank('line')}) as n_pages from l group by file)
select file, n_pages, n_pages = 0 as empty, case when n_pages = 0 then {q(C.REJECT_NO_TEXT)} end as reject_reason
from n"""
SQL["max_chapters_guard"] = f"""select book_id, count(*) as n_chapters, count(*) <= 5 as accepted,
  case when count(*) > 5 then {q(C.REJECT_TOO_MANY_CHAPTERS.format(max=5))} end as reject_reason
from ({CONV_CH}) group by book_id"""
SQL["blank_chapter_guard"] = f"""with g as (select conv_id as book_id, count(*) as n,
  count(*) filter (where (conv_id + turn) % 7 = 0) as extra, bool_or({blank('text')}) as own
  from conversations group by conv_id)
select book_id, n + extra as n_chapters, own or extra > 0 as has_blank, not (own or extra > 0) as accepted,
  case when own or extra > 0 then {q(C.REJECT_BLANK_CHAPTER)} end as reject_reason from g"""
SQL["progress_domain"] = ("select event_id, value / 100.0 as progress, "
                          "value / 100.0 between 0 and 1 as in_domain from events")
_REQ = ("case event_type when 'purchase' then 'pdf' when 'click' then 'PDF' when 'view' then 'docx' "
        "when 'error' then 'txt' end")
SQL["format_normalise"] = (f"select event_id, {_REQ} as requested, case when {_REQ} = 'pdf' then 'pdf' "
                           f"else 'docx' end as normalised from events")
SQL["validation_first_failure"] = (f"with {file_checks()} select file, content_type, length, n_pages, "
                                   f"reject_reason from fc")
SQL["download_gate"] = f"""with {STATE}, {PROBES}, {LISTING}
select p.job_id,
  case when s.job_id is null then 404 when s.status <> 'completed' then 400 when s.file_path is null then 404
       when l.path is null then 404 else 200 end as http_status,
  case when s.job_id is null then {q(C.GATE_UNKNOWN[1])} when s.status <> 'completed' then {q(C.GATE_NOT_DONE[1])}
       when s.file_path is null then {q(C.GATE_NO_PATH[1])} when l.path is null then {q(C.GATE_FILE_GONE[1])}
  end as detail,
  case when s.job_id is not null and s.status = 'completed' and s.file_path is not null and l.path is not null
       then {q(C.DOWNLOAD_BASENAME + '.')} || string_split(s.file_path, '.')[-1] end as filename
from probes p left join state s using (job_id) left join listing l on l.path = s.file_path"""

# --- D ---------------------------------------------------------------------------------
SQL["job_lookup"] = f"""with {STATE}, {PROBES}
select job_id, status, progress, current_chapter, total_chapters, message from probes join state using (job_id)"""
SQL["job_lookup_missing"] = f"""with {STATE}, {PROBES}
select job_id, {C.GATE_UNKNOWN[0]} as http_status, {q(C.GATE_UNKNOWN[1])} as detail
from probes where job_id not in (select job_id from state)"""
_names = " ".join(f"when {q(k)} then {q(v)}" for k, v in LANG_NAMES.items())
_langs = ", ".join(q(x) for x in C.LANGUAGES)
SQL["language_semi"] = (f"select doc_id, case lang {_names} end as language, "
                        f"coalesce(case lang {_names} end in ({_langs}), false) as supported from documents")
SQL["status_with_default"] = f"""with {STATE}, {PROBES}
select p.job_id, coalesce(s.status, 'completed') as status, coalesce(s.progress, 1.0) as progress,
  coalesce(s.current_chapter, 1) as current_chapter, coalesce(s.total_chapters, 1) as total_chapters,
  coalesce(s.message, {q(C.MSG_MISSING_AS_DONE)}) as message
from probes p left join state s using (job_id)"""
SQL["edit_update"] = f"""select book_id, id, id % 4 = 0 as edited,
  case when id % 8 = 0 then '[rev 2] ' || content
       when id % 4 = 0 then '[rev 1] ' || content else content end as content
from ({DOC_CH})"""
_styles = ", ".join("(" + ", ".join("NULL" if v is None else (q(v) if isinstance(v, str) else str(v))
                                     for v in row) + ")" for row in C.STYLES)
SQL["styled_elements"] = f"""with ch as ({CONV_CH}), {docx_ctes('ch')}, {pdf_ctes('ch')},
st(format, kind, font, size, style_align, "leading", indent, space_after, sheight) as (values {_styles}),
allx as (select 'docx' as format, * from docx union all select 'pdf', * exclude (element_error) from pdf)
select a.format, a.book_id, a.seq, a.kind, st.font, cast(st.size as double) as size,
  case when st.style_align = 'PARITY' then a.align else coalesce(st.style_align, a.align) end as align,
  cast(st."leading" as double) as "leading", cast(st.indent as double) as indent,
  cast(st.space_after as double) as space_after, a.height_in
from allx a left join st on st.format = a.format and st.kind = a.kind"""
SQL["page_geometry"] = f"""select distinct source as book_id, {C.PAGE_WIDTH_IN}::DOUBLE as page_width_in,
  {C.PAGE_HEIGHT_IN}::DOUBLE as page_height_in, {C.MARGIN_LEFT_IN}::DOUBLE as margin_left_in,
  {C.MARGIN_RIGHT_IN}::DOUBLE as margin_right_in, {C.MARGIN_TOP_IN}::DOUBLE as margin_top_in,
  {C.MARGIN_BOTTOM_IN}::DOUBLE as margin_bottom_in, 4.75::DOUBLE as text_width_in, 8.0::DOUBLE as text_height_in
from documents"""

# --- E ---------------------------------------------------------------------------------
SQL["reassemble_chapters"] = f"""select book_id, id, content from ({reassembled(
    f"select *, case when {blank('chunk')} then '' else {strip('chunk')} end as translated from ({chunks(DOC_CH)})")})"""
SQL["chapter_counts"] = "select source as book_id, count(*) as n_chapters from documents group by 1"
SQL["chapter_length_lists"] = f"""select book_id, string_agg(cast(id as varchar), ',' order by id, ordinal) as ids,
  string_agg(cast(length(content) as varchar), ',' order by id, ordinal) as lengths
from ({CONV_CH}) group by book_id"""
SQL["next_chapter_id"] = """select c_custkey as book_id, coalesce(max(turn) + 1, 0) + 1 as next_id
from customer left join conversations on conv_id = c_custkey group by c_custkey"""
SQL["layout_counts"] = f"""with ch as ({blanked(paragraphed(DOC_CH), 7, '')}),
pc as (select book_id, ordinal, count(*) filter (where not {blank('para')}) as nb from
  (select book_id, ordinal, unnest(string_split(content, {NL2})) as para from ch) group by all),
c as (select ch.book_id, cast(ceil(length(content) / 3000.0) as bigint) as n_pages, coalesce(pc.nb, 0) as nb,
  row_number() over (partition by ch.book_id order by ch.id desc, ch.ordinal desc) as rlast
  from ch left join pc using (book_id, ordinal)),
g as (select book_id, count(*) as n_chapters, sum(n_pages) as n_pages, sum(nb) as n_paragraphs,
  count(*) filter (where n_pages > 0) as with_pages,
  max(case when rlast = 1 then n_pages end) as last_pages from c group by 1)
select book_id, n_chapters, cast(n_pages as bigint) as n_pages, cast(n_paragraphs as bigint) as n_paragraphs,
  cast(n_chapters + 3 * n_pages + with_pages - case when last_pages > 0 then 1 else 0 end as bigint) as docx_elements,
  cast(3 * n_chapters - 1 + 2 * n_paragraphs as bigint) as pdf_elements from g"""
SQL["extraction_summary"] = f"""with l as (select id as file, unnest(string_split(content, chr(10))) as text
  from ({paragraphed(DOC_CH)}))
select file, count(*) as n_pages, count(*) filter (where not {blank('text')}) as n_extracted,
  count(*) filter (where {blank('text')}) as n_skipped,
  cast(coalesce(sum(case when not {blank('text')} then length(text) end), 0) as bigint) as n_chars
from l group by file"""
SQL["char_volume"] = f"""with r as ({reassembled(mock_translated(DOC_CH), carry=', lang')}),
s as (select source as book_id, doc_id as ordinal, length(text) as n from documents)
select lang, count(*) as n_chapters, cast(sum(s.n) as bigint) as chars_in,
  cast(sum(length(r.content)) as bigint) as chars_out from r join s using (book_id, ordinal) group by lang"""
SQL["chunk_plan"] = f"""select book_id, id, cast(length(content) as bigint) as n_chars,
  cast(greatest(ceil(length(content) / 4000.0), 1) as bigint) as n_chunks, length(content) <= 4000 as single_request
from ({DOC_CH})"""

# --- F ---------------------------------------------------------------------------------
SQL["chapter_index"] = f"with {page_rows(DOC_CH)} select book_id, id, ch_idx, n_chapters from pos"
SQL["page_numbers"] = f"with {page_rows(DOC_CH)} select book_id, id, page_idx, page_no, {ALIGN} as align from pages"
SQL["page_breaks"] = (f"with {page_rows(blanked(DOC_CH, 7, ''))} "
                      f"select book_id, id, page_idx, {HAS_BREAK} as has_break from pages")
_PROG = "0.1::DOUBLE + 0.6::DOUBLE * (cast(ch_idx as double) / cast(n_chapters as double))"
SQL["translate_progress"] = f"""with {page_rows(CONV_CH)}
select book_id, id, {_PROG} as progress, cast(ch_idx + 1 as integer) as current_chapter,
  {q(C.MSG_CHAPTER_PREFIX)} || cast(id as varchar) || '/' || cast(n_chapters as varchar) || '...' as message from pos"""
SQL["latest_job_state"] = f"with {STATE} select * from state"
SQL["stage_durations"] = f"""with ev as ({job_events_sql()}),
l as (select job_id, event_id, status, lag(status) over w as prev_status,
  date_diff('microsecond', lag(ts) over w, ts) as us from ev window w as (partition by job_id order by ts, event_id))
select job_id, event_id, status, prev_status, us / 1e6 as duration_s, {fixed_decimal('us', 1000000, 4)} as duration_text
from l"""

# --- G ---------------------------------------------------------------------------------
SQL["ordered_chapters"] = """select book_id, id, ordinal, row_number() over (partition by book_id order by id, ordinal) as pos
from (select source as book_id, doc_id % 10 as id, doc_id as ordinal from documents)"""
SQL["paginate_docx"] = f"""select 'default' as layout, book_id, id, idx as page_idx, piece as text from ({slices(DOC_CH, 3000, 10)})
union all
select 'small', book_id, id, idx, piece from ({slices(DOC_CH, 500, 3)})"""
SQL["truncation_audit"] = " union all ".join(f"""select '{name}' as layout, book_id, id,
  cast(length(content) as bigint) as n_chars, cast(least(ceil(length(content) / {w}.0), {cap}) as integer) as pages_kept,
  cast(ceil(length(content) / {w}.0) - least(ceil(length(content) / {w}.0), {cap}) as integer) as pages_dropped,
  cast(greatest(length(content) - {w * cap}, 0) as bigint) as chars_lost
from ({DOC_CH})""" for name, w, cap in (("default", 3000, 10), ("small", 500, 3)))

# --- H ---------------------------------------------------------------------------------
SQL["intake_union"] = f"""with {PAGE_FILES}, {PAGE_LINES}
select 'conv-' || cast(conv_id as varchar) as book_id, turn + 1 as id, 'chapters' as intake,
  cast(length(text) as bigint) as n_chars from conversations
union all
select 'file-' || cast(file as varchar), cast(id as bigint), 'files', cast(length(line) as bigint) from pl
where not {blank('line')}"""
SQL["edit_append"] = f"""select book_id, id, ordinal, content from ({CONV_CH})
union all select book_id, max(id) + 1, max(ordinal) + 1, '' from ({CONV_CH}) group by book_id"""
SQL["edit_remove"] = f"""with ch as ({CONV_CH}), n as (select book_id, count(*) as n from ch group by 1)
select book_id, id, ordinal from ch join n using (book_id)
where case when n = 1 then true when book_id % 3 = 0 then id = n else id <> 1 end"""

# The fold itself, edit by edit, over whole lists of chapters.
_TOP = "coalesce(list_max(list_transform(live, lambda x: x.id)), 0)"
_LEFT = "list_filter(live, lambda x: x.id <> e_id)"
_HIT = "len(list_filter(live, lambda x: x.id = e_id)) > 0"
SQL["edit_log"] = f"""with recursive ch as ({CONV_CH}), n as (select book_id, count(*) as n from ch group by 1),
x as (select ch.*, n, book_id as c, ordinal as t from ch join n using (book_id)),
log as (
  select book_id, 5 * t as seq, 'append' as op, null::bigint as id, null::varchar as content from x where (c + t) % 5 <= 1 and c % 3 <> 0
  union all select book_id, 5 * t, 'remove', id, null from x where (c + t) % 5 = 2
  union all select book_id, 5 * t, 'update', id, '[log] ' || content from x where (c + t) % 5 = 3
  union all select book_id, 5 * t, 'remove', n + 1, null from x where (c + t) % 5 = 4
  union all select book_id, 5 * t + 1, 'update', n + 1 + t % 2, 'new ' || t from x where (c * 7 + t) % 3 = 0
  union all select book_id, 5 * t + 2, 'remove', id, null from x where c % 6 = 0
  union all select book_id, 5 * t + 3, 'append', null, null from x where (c + t) % 2 = 0 and c % 3 <> 0
  union all select book_id, 5 * t + 4, 'update', n + t, 'last ' || content from x where (c + t) % 4 = 0),
e as (select *, row_number() over (partition by book_id order by seq) as k from log),
step as (
  select book_id, 0::bigint as k, list({{'id': id::bigint, 'ord': ordinal::bigint, 'c': content}} order by ordinal) as live,
    max(ordinal)::bigint + 1 as nxt, null::bigint as seq, null::varchar as op, null::bigint as eid, null::varchar as status
  from ch group by book_id
  union all
  select book_id, k + 1,
    case when e_op = 'append' then list_append(live, {{'id': top + 1, 'ord': nxt, 'c': ''}})
         when e_op = 'update' then list_transform(live, lambda x: case when x.id = e_id
           then {{'id': x.id, 'ord': x.ord, 'c': e_content}} else x end)
         when left_over = 0 then live else {_LEFT} end,
    nxt + case when e_op = 'append' then 1 else 0 end, e_seq, e_op, case when e_op = 'append' then top + 1 else e_id end,
    case when e_op = 'append' then 'applied' when not hit then 'missing'
         when e_op = 'remove' and left_over = 0 then 'refused' else 'applied' end
  from (select step.book_id, step.k, live, nxt, e.seq as e_seq, e.op as e_op, e.id as e_id, e.content as e_content,
          {_TOP} as top, len({_LEFT.replace('e_id', 'e.id')}) as left_over, {_HIT.replace('e_id', 'e.id')} as hit
        from step join e on e.book_id = step.book_id and e.k = step.k + 1)),
last as (select book_id, max_by(live, k) as live from step group by book_id)
select book_id, seq, op, eid as id, status, null::bigint as ordinal, null::varchar as content from step where k > 0
union all select book_id, null, 'chapter', x.id, 'live', x.ord, x.c from (select book_id, unnest(live) as x from last)"""

# --- I ---------------------------------------------------------------------------------
SQL["blank_flags"] = f"select id as doc_id, {blank('content')} as is_blank from ({blanked(DOC_CH)})"
SQL["strip_text"] = f"select doc_id, {strip(chr(39) + ' ' + chr(39) + ' || text || chr(10)')} as stripped from documents"
SQL["chunk_chapters"] = f"select book_id, id, chunk_idx, chunk from ({chunks(DOC_CH)})"
SQL["drop_caps"] = f"""select book_id, id, substring(piece, 1, 1) as cap, substring(piece, 2) as rest
from ({slices(CONV_CH, 3000)}) where idx = 0"""
SQL["split_paragraphs"] = f"""with p as (select book_id, id, unnest(string_split(content, {NL2})) as para,
  unnest(range(0, len(string_split(content, {NL2})))) as i from ({paragraphed(DOC_CH)}))
select book_id, id, cast(i as integer) as para_idx, {esc('para')} as text from p where not {blank('para')}"""
SQL["xml_escape"] = f"select page_id, {esc('html')} as escaped from pages"
SQL["chapter_titles"] = f"select book_id, id, {title('id')} as title from ({DOC_CH})"
SQL["size_text"] = f"""with {PAGE_FILES}
select file, length, {fixed_decimal('length', 1024, 2)} as kb, {fixed_decimal('length', 1048576, 1)} as mb1,
  {fixed_decimal('length', 1048576, 2)} as mb2 from pf"""
SQL["download_names"] = f"""select event_id, file_path, string_split(file_path, '.')[-1] as ext,
  {q(C.DOWNLOAD_BASENAME + '.')} || string_split(file_path, '.')[-1] as filename,
  regexp_extract(file_path, '^(.*)/[^/]*$', 1) as parent
from ({job_events_sql()}) where file_path is not null"""
SQL["submit_jobs"] = f"with {jobs_both()} select * from jobs"
SQL["job_messages"] = f"""with {page_rows(CONV_CH)}
select book_id, id, {q(C.MSG_CHAPTER_PREFIX)} || cast(id as varchar) || '/' || cast(n_chapters as varchar) || '...'
  as message, ({_PROG}) * 100 as percent from pos"""
SQL["mask_secret"] = """select c_custkey, k as key,
  substring(k, 1, 4) || '...' || case when length(k) > 8 then right(k, 4) else '' end as masked
from (select c_custkey, c_name as k from customer
  union all select c_custkey, substring(c_name, 1, cast(c_custkey % 13 as integer)) from customer)"""
_sys = (C.ModelOptions().system_template.replace("{source}", C.ModelOptions().source_language)
        .replace("{target}", LANG))
SQL["build_prompts"] = f"""select book_id, id, chunk_idx, 'system' as system_role, {q(_sys)} as system_content,
  'user' as user_role, chunk as user_content, {q(C.MODEL)} as model, {C.TEMPERATURE}::DOUBLE as temperature,
  cast({C.MAX_TOKENS} as integer) as max_tokens from ({chunks(DOC_CH)})"""
SQL["parse_completion"] = "select doc_id, text as content from documents"
SQL["translate_mock"] = f"""select doc_id, {mock('text')} as text_mock,
  {q(C.MOCK_CHAPTER_PREFIX + LANG + ': ')} || substring(text, 1, {C.MOCK_CHAPTER_PREVIEW}) || '...' as chapter_mock,
  'Chapter ' || cast(doc_id as varchar) || ' translated to ' || {q(LANG)} as batch_mock from documents"""

# --- J ---------------------------------------------------------------------------------
SQL["translate_chunks"] = (f"select book_id, id, chunk_idx, translated, attempts, wait_s, failed "
                           f"from ({mock_translated(DOC_CH)})")
SQL["translate_blank_skip"] = (f"select book_id, id, chunk_idx, translated, attempts, wait_s, failed "
                               f"from ({mock_translated(blanked(DOC_CH))})")
SQL["translate_retry"] = (f"select book_id, id, chunk_idx, translated, attempts, wait_s, error "
                          f"from ({flaky(DOC_CH, 'id')})")
_CONV_FK = f"select *, book_id + ordinal as fault_key from ({CONV_CH})"
SQL["translate_books"] = f"""select book_id, bool_or(error is not null) as failed,
  min(error) as error, count(*) as n_chunks, cast(sum(attempts) as bigint) as n_calls
from ({flaky(_CONV_FK, 'fault_key')}) group by book_id"""

_NEW = f"select * replace (id + {EXTRA} as id, ordinal + {EXTRA} as ordinal, 'new ' || content as content) from ({DOC_CH}) where id % 7 = 0"
SQL["translation_memory"] = f"""with one as ({mock_translated(DOC_CH)}),
two as ({mock_translated(f"{DOC_CH} union all {_NEW}")})
select 1 as run, book_id, id, chunk_idx, translated, attempts, failed from one
union all select 2, book_id, id, chunk_idx, translated,
  case when chunk in (select chunk from one) then 0::integer else attempts end, failed from two"""
SQL["translate_waves"] = f"""with c as (select *, idx as chunk_idx, piece as chunk from ({slices(_CONV_FK, 200, keep_empty=True)})),
p as (select *, (row_number() over (partition by book_id order by id, ordinal, chunk_idx) - 1) // {WAVE} + 1 as w,
  case when book_id % 3 = 0 and (fault_key + chunk_idx) % 10 = 9 then 5 else chunk_idx % 3 end as key from c),
a as (select book_id, length(bin(w)) - 1 as wave, not {blank('chunk')} and key >= 4 as bad,
  case when {blank('chunk')} then 0 else least(key + 1, 4) end as attempts from p),
f as (select book_id, min(wave) filter (where bad) as stop from a group by book_id)
select book_id, bool_or(bad) as failed, cast(max(wave) as integer) as last_wave, count(*) as n_sent,
  cast(sum(attempts) as bigint) as n_calls from a join f using (book_id) where wave <= coalesce(stop, wave) group by book_id"""

# --- K ---------------------------------------------------------------------------------
_MAX = JOB_OPTIONS.limits.max_chapters
_WITHIN = f"book_id in (select conv_id from conversations group by conv_id having count(*) <= {_MAX})"
SQL["job_elements"] = f"""with f as (select * from ({flaky(_CONV_FK, 'fault_key')}) where {_WITHIN}),
r as (select book_id, ordinal, id, string_agg(translated, chr(10) order by chunk_idx) as content from f
  where book_id not in (select book_id from f where error is not null) group by all),
{docx_ctes('select * from r')}
select {_JOBID_CONV} as job_id, seq, kind, chapter_id, text, page_no from docx"""
SQL["job_rejects"] = f"""select conv_id as book_id, count(*) as n_chapters,
  {q(C.REJECT_TOO_MANY_CHAPTERS.format(max=_MAX))} as reject_reason
from conversations group by conv_id having count(*) > {_MAX}"""
SQL["job_lifecycle"] = f"""with c as (select book_id, id, ordinal, bool_or(error is not null) as bad, min(error) as error
  from ({flaky(_CONV_FK, 'fault_key')}) where {_WITHIN} group by all),
p as (select *, row_number() over w - 1 as idx, count(*) over (partition by book_id) as n,
  coalesce(bool_or(bad) over (w rows between unbounded preceding and 1 preceding), false) as stopped
  from c window w as (partition by book_id order by id, ordinal)),
o as (select book_id, bool_or(bad) as failed, min(error) as error from c group by book_id),
j as (select {_JOBID_CONV} as job_id, o.* from o)
select job_id, 0 as seq, 0 as step, {q(C.STATUS_QUEUED)} as status, 0.0::DOUBLE as progress, {q(C.MSG_QUEUED)} as message,
  NULL::VARCHAR as file_path, 0::INTEGER as current_chapter from j
union all select job_id, 1, 0, {q(C.STATUS_TRANSLATING)}, 0.1, {q(C.MSG_TRANSLATING)}, NULL, NULL from j
union all select {_JOBID_CONV}, 1, cast(idx + 1 as integer), {q(C.STATUS_TRANSLATING)},
  0.1::DOUBLE + 0.6::DOUBLE * (cast(idx as double) / cast(n as double)),
  {q(C.MSG_CHAPTER_PREFIX)} || id || '/' || n || '...', NULL, cast(idx + 1 as integer) from p where not stopped
union all select job_id, 2, 0, 'error', NULL, {q(C.MSG_ERROR_PREFIX)} || error, NULL, NULL from j where failed
union all select job_id, 2, 0, {q(C.STATUS_FORMATTING)}, 0.7, {q(C.MSG_FORMATTING)}, NULL, NULL from j where not failed
union all select job_id, 3, 0, {q(C.STATUS_COMPLETED)}, 1.0, {q(C.MSG_COMPLETED)}, 'output/' || job_id || '.docx', NULL
from j where not failed"""
_CONTENT = f"sha256(string_agg({coded('id')} || {coded('content')}, '' order by ordinal))"


def _submitted(lang: str, fmt: str) -> str:
    named = " || ".join(coded(x) for x in ("book_id", q(lang), q(fmt), "null"))
    return f"sha256({named} || {_CONTENT})"


SQL["published_downloads"] = f"""with o as (select book_id, bool_or(error is not null) as failed
  from ({flaky(_CONV_FK, 'fault_key')}) where {_WITHIN} group by book_id),
s as (select book_id, {q(LANG)} as lang, 'docx' as fmt, {_submitted(LANG, 'docx')} as sub from ({CONV_CH}) group by book_id
  union all select book_id, {q(OTHER_LANG)}, {q(OTHER_FORMAT)}, {_submitted(OTHER_LANG, OTHER_FORMAT)} from ({CONV_CH})
  where book_id % 4 = 0 group by book_id),
j as (select {job_id('chapters', 'book_id', 'sub', 'lang', 'fmt')} as job_id, fmt, failed,
  book_id % 5 <> 0 as there from s join o using (book_id)),
probes as (select job_id, fmt, failed, there from j
  union all select replace(job_id, '0', 'x'), null, null, false from j where contains(job_id, '0'))
select job_id, case when not there then {C.GATE_UNKNOWN[0]} when failed then {C.GATE_NOT_DONE[0]} else 200 end as http_status,
  case when not there then {q(C.GATE_UNKNOWN[1])} when failed then {q(C.GATE_NOT_DONE[1])} end as detail,
  case when there and not failed then {q(C.DOWNLOAD_BASENAME + '.')} || fmt end as filename from probes"""
SQL["job_errors"] = f"with {STATE} select job_id, message, progress from state where status = 'error'"
SQL["job_status"] = (f"with {STATE} select job_id, status, progress, current_chapter, total_chapters, message "
                     f"from state")
SQL["open_jobs"] = (f"with {STATE} select job_id, status, progress from state "
                    f"where status not in ('completed', 'error')")
SQL["flagship_translate_books"] = f"""with r as ({reassembled(mock_translated(DOC_CH))}), {page_rows('select * from r')}
select book_id, id, page_idx, page_no, {ALIGN} as align, {HAS_BREAK} as has_break, text from pages"""

# --- L ---------------------------------------------------------------------------------
SQL["docx_elements"] = (f"with ch as ({blanked(DOC_CH, 7, '')}), {docx_ctes('ch')} "
                        f"select book_id, seq, kind, chapter_id, part_idx, text, page_no, align from docx")
SQL["pdf_elements"] = (f"with ch as ({paragraphed(DOC_CH)}), {pdf_ctes('ch')} "
                       f"select book_id, seq, kind, chapter_id, part_idx, text, height_in from pdf")
SQL["layout_errors"] = f"""with ch as (select * replace (id % 10 as id) from (select * from ({blanked(DOC_CH, 11, None)})
  union all select * replace (id + {2 * EXTRA} as id, ordinal + {2 * EXTRA} as ordinal, 'bad ' || chr(1) || content as content)
  from ({DOC_CH}) where id % 13 = 0)), {pdf_ctes('ch')}
select book_id, seq, kind, chapter_id, element_error from pdf"""
SQL["render_book_text"] = f"""with ch as ({CONV_CH}), {docx_ctes('ch')}
select book_id, rtrim(string_agg(case kind when 'break' then chr(12) || chr(10) when 'dropcap' then text
  else text || chr(10) end, '' order by seq), chr(10)) as text, count(*) as n_elements
from docx group by book_id"""

SQL["book_segments"] = f"""with ch as ({DOC_CH}), {docx_ctes('ch')},
t as (select book_id, seq, case kind when 'break' then chr(12) || chr(10) when 'dropcap' then text
  else text || chr(10) end as text from docx)
select book_id, seq, cast(coalesce(sum(strlen(text)) over (partition by book_id order by seq
  rows between unbounded preceding and 1 preceding), 0) as bigint) as start, strlen(text) as n_bytes, text from t"""

# --- M ---------------------------------------------------------------------------------
SQL["run_log_durations"] = f"""with ev as ({job_events_sql()}),
g as (select job_id, count(*) as n_events, first(status order by ts, event_id) as first_status,
  last(status order by ts, event_id) as last_status, date_diff('microsecond', min(ts), max(ts)) as us
  from ev group by job_id)
select job_id, n_events, first_status, last_status, us / 1e6 as elapsed_s,
  {fixed_decimal('us', 1000000, 4)} as elapsed_text from g"""
SQL["pipeline_metrics"] = """with g as (select source as book_id, count(*) as n_chapters,
  sum(greatest(ceil(length(text) / 4000.0), 1)) as n_chunks, sum(ceil(length(text) / 3000.0)) as n_pages,
  sum(length(text)) as n_chars from documents group by 1)
select book_id, 'n_chapters' as metric, cast(n_chapters as bigint) as value from g
union all select book_id, 'n_chunks', cast(n_chunks as bigint) from g
union all select book_id, 'n_pages', cast(n_pages as bigint) from g
union all select book_id, 'n_chars', cast(n_chars as bigint) from g"""

SQL["run_log_stages"] = """with g as (select count(*) as n_chapters, sum(greatest(ceil(length(text) / 4000.0), 1)) as n_chunks,
  sum(ceil(length(text) / 3000.0)) as n_pages, sum(length(text)) as n_chars from documents),
m as (unpivot (select n_chapters::bigint as n_chapters, n_chunks::bigint as n_chunks, n_pages::bigint as n_pages,
  n_chars::bigint as n_chars from g) on n_chapters, n_chunks, n_pages, n_chars into name metric value v)
select 'layout' as stage, 'documents' as subject, 'finished' as status, true as timed, null::boolean as told, metric, v as value from m
union all select 'layout', 'documents', 'started', null, null, null, null
union all select 'check', 'documents', 'started', null, null, null, null
union all select 'check', 'documents', 'failed', true, true, null, null"""

# --- N ---------------------------------------------------------------------------------
SQL["stream_intake"] = f"""with {_BOOKS},
a as (select cast(conv_id as varchar) as book_id, {q(LANG)} as lang, 'docx' as fmt, n from b
  union all select cast(conv_id as varchar), {q(OTHER_LANG)}, {q(OTHER_FORMAT)}, n from b where conv_id % 4 = 0)
select book_id, case when n > {_MAX} then {q(C.REJECT_TOO_MANY_CHAPTERS.format(max=_MAX))} else 'accepted' end as outcome,
  lang as target_language, case when n <= {_MAX} then fmt end as output_format,
  case when n <= {_MAX} then {q(C.STATUS_QUEUED)} end as status, n as n_chapters from a
union all select 'empty-' || conv_id, {q(C.REJECT_NO_CHAPTERS)}, {q(LANG)}, null, null, 0 from b where conv_id % 9 = 0
union all select 'silent-' || conv_id, 'field required: target_language', null, null, null, null from b where conv_id % 9 = 1
union all select 'typed-' || conv_id, 'malformed request', {q(LANG)}, null, null, null from b where conv_id % 9 = 2"""
SQL["stream_queue"] = f"""with s as (
  select book_id, {q(LANG)} as lang, 'docx' as fmt, {_submitted(LANG, 'docx')} as sub, count(*) as n from ({CONV_CH}) group by book_id
  union all select book_id, {q(OTHER_LANG)}, {q(OTHER_FORMAT)}, {_submitted(OTHER_LANG, OTHER_FORMAT)}, count(*)
  from ({CONV_CH}) where book_id % 4 = 0 group by book_id),
j as (select cast(book_id as varchar) as book_id, fmt, {job_id('chapters', 'book_id', 'sub', 'lang', 'fmt')} as job_id
  from s where n <= {_MAX})
select job_id, book_id, 1::bigint as n_runs, case when left(job_id, 1) < '8' then 'run-1' else 'run-2' end as run,
  'completed' as status, 'output/' || job_id || '.' || fmt as file_path from j"""
SQL["stream_translate"] = f"""with ok as (select conv_id from conversations group by conv_id having count(*) <= {_MAX}),
r as ({reassembled(mock_translated(CONV_CH))}), {docx_ctes('select * from r where book_id in (select conv_id from ok)')},
r2 as ({reassembled(mock_translated(CONV_CH, OTHER_LANG))}),
{pdf_ctes('select * from r2 where book_id % 4 = 0 and book_id in (select conv_id from ok)')}
select cast(book_id as varchar) as book_id, {q(LANG)} as target_language, seq, kind, text from docx
union all select cast(book_id as varchar), {q(OTHER_LANG)}, seq, kind, text from pdf"""
SQL["stream_job_state"] = (f"with {STATE} select job_id, status, message, progress, file_path, current_chapter, "
                           f"total_chapters, n_events from state")
_STUCK = job_timers.STUCK_MS
SQL["stream_job_timers"] = f"""with ev as ({job_events_sql()}),
first as (select * from ev where status not in ('completed', 'error')
  qualify row_number() over (partition by job_id order by ts, event_id) = 1),
al as (select * from ev union all select * replace (job_id + {SILENT} as job_id) from first),
o as (select *, epoch_us(ts) // 1000 as ms, epoch_us(max(ts) over ()) // 1000 - {TIMER_DELAY_DAYS * 86_400_000} as mark,
  row_number() over w as i, lead(epoch_us(ts) // 1000) over w as next_ms
  from al window w as (partition by job_id order by ts, event_id)),
c as (select *, status in ('completed', 'error') as over,
  status not in ('completed', 'error') and coalesce(next_ms - ms > {_STUCK}, mark - ms >= {_STUCK}) as stuck from o),
stop as (select job_id, min(i) filter (where over or stuck) as stop, count(*) as n from c group by job_id),
k as (select c.*, coalesce(stop, n) as upto, stop is not null as closed from c join stop using (job_id)
  where i <= coalesce(stop, n))
select job_id, max_by(case when stuck then 'error' else status end, i) as status,
  max_by(case when stuck then {q(job_timers.STUCK_MESSAGE.format(s=_STUCK // 1000))} else message end, i) as message,
  coalesce(max_by(progress, i) filter (where progress is not null), 0.0) as progress,
  max_by(file_path, i) filter (where file_path is not null) as file_path,
  coalesce(max_by(current_chapter, i) filter (where current_chapter is not null), 0)::integer as current_chapter,
  coalesce(max_by(total_chapters, i) filter (where total_chapters is not null), 0)::integer as total_chapters,
  bool_or(closed) as closed, count(*) as n_events from k group by job_id"""
