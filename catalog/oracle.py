"""DuckDB SQL with the same results as catalog.queries, over the same given tables."""

from catalog import fixtures as X
from roomtrace import constants as K

D = X.for_duckdb
RAW, SEARCHES, BOOKINGS = D(X.RAW_LISTINGS), D(X.SEARCH_REQUESTS), D(X.BOOKING_REQUESTS)
TURNS, STEPS, ATTEMPTS, RUNS, ASKED = D(X.TURNS), D(X.STEPS), D(X.ATTEMPTS), D(X.RUNS), D(X.ASKED)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"trim(coalesce({c}, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def unaccent(c: str) -> str:
    return f"strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D'))"


def key(c: str) -> str:
    return f"regexp_replace(lower({unaccent(c)}), '[^a-z0-9]', '', 'g')"


def mask(c: str) -> str:
    once = "regexp_replace({}, '(^|[^0-9])0[0-9]{{9,10}}($|[^0-9])', '\\1[đã ẩn SĐT]\\2', 'g')"
    return once.format(once.format(c))


def printf(pattern: str, *args: str) -> str:
    parts, rest = [], list(args)
    for i, piece in enumerate(pattern.replace("%d", "%s").split("%s")):
        if i:
            parts.append(f"CAST({rest.pop(0)} AS VARCHAR)")
        if piece:
            parts.append(lit(piece).replace("\n", "' || chr(10) || '"))
    return "(" + " || ".join(parts) + ")"


AREA = f"TRY_CAST(replace(regexp_extract({strip('area_raw')}, '(?i)^([0-9.,]+)\\s*m2$', 1), ',', '.') AS DOUBLE)"
_P = strip("price_raw")


def _number(unit: str) -> str:
    return f"regexp_extract({_P}, '^([0-9.,]+)\\s*{unit}$', 1)"


def _digits(unit: str) -> str:
    return f"TRY_CAST(replace(replace({_number(unit)}, '.', ''), ',', '') AS BIGINT)"


PRICE = f"""CASE
  WHEN {_number('triệu/tháng')} <> ''
    THEN CAST(trunc(TRY_CAST(replace({_number('triệu/tháng')}, ',', '.') AS DOUBLE) * 1000000) AS BIGINT)
  WHEN {_number('đồng/m2/tháng')} <> '' THEN CAST(trunc({_digits('đồng/m2/tháng')} * {AREA}) AS BIGINT)
  WHEN {_number('đồng/tháng')} <> '' THEN {_digits('đồng/tháng')} END"""
_M = "regexp_extract(posted_raw, '([0-9]{1,2}):([0-9]{2})\\s+([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})', ['h', 'i', 'd', 'm', 'y'])"
POSTED = f"""CASE WHEN TRY_CAST({_M}.h AS INT) < 24 THEN TRY_CAST(
  {_M}.y || '-' || lpad({_M}.m, 2, '0') || '-' || lpad({_M}.d, 2, '0') || ' ' || lpad({_M}.h, 2, '0') || ':' || {_M}.i || ':00'
  AS TIMESTAMP) END"""
NOW = f"TIMESTAMP '{X.NOW}'"


def days(c: str) -> str:
    return f"CAST(floor((epoch({NOW}) - epoch({c})) / 86400.0) AS INTEGER)"


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"


def amenities(c: str, sep: str = "; ") -> str:
    words: dict[str, list[str]] = {}
    for word, label in K.AMENITIES:
        words.setdefault(label, []).append(word)
    cases = [
        "CASE WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in ws) + f" THEN '{label}' END"
        for label, ws in words.items()
    ]
    return f"concat_ws('{sep}', {', '.join(cases)})"


ID = f"""coalesce(nullif(regexp_extract({strip('link_raw')}, '-(pr[0-9]+)\\.html', 1), ''),
  'gen' || lpad(CAST(row_index AS VARCHAR), CAST(greatest(4, length(CAST(row_index AS VARCHAR))) AS INTEGER), '0'))"""
DISTRICT = f"CASE WHEN {strip('address_raw')} = '' THEN 'Không rõ' ELSE {strip(f'''split_part({strip('address_raw')}, ',', 1)''')} END"
HAYSTACK = f"lower({unaccent(f'''{strip('title_raw')} || ' ' || {strip('descr_raw')}''')})"

# normalised rows, deduplicated rows, last row per id
LISTINGS = f"""raw AS ({RAW}),
typed AS (SELECT *, {AREA} AS area_m2, {PRICE} AS price_vnd, {POSTED} AS posted_ts, {DISTRICT} AS district,
                 {HAYSTACK} AS hay, {ID} AS id FROM raw),
norm AS (SELECT row_index, id, {mask(strip('title_raw'))} AS title, price_vnd, {strip('price_raw')} AS price_label, area_m2,
           district, {key('district')} AS district_key, {strip('address_raw')} AS address,
           {amenities('hay')} AS amenities, {mask(strip('descr_raw'))} AS description,
           {iso('posted_ts')} AS posted_at, {days('posted_ts')} AS days_old, {strip('link_raw')} AS url
         FROM typed WHERE area_m2 > 0 AND (price_vnd IS NULL OR price_vnd >= 100000)),
lst AS (SELECT * FROM norm WHERE url = ''
        UNION ALL
        SELECT * FROM norm WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY row_index) = 1),
latest AS (SELECT * FROM lst QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_index DESC) = 1)"""


def with_listings(select: str) -> str:
    return f"WITH {LISTINGS} {select}"


def from_raw(**columns: str) -> str:
    chosen = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT row_index, {chosen} FROM ({RAW})"


# --- search ---------------------------------------------------------------------
SEARCH = f"""{LISTINGS},
req AS (SELECT *, {key("coalesce(district, '')")} AS k,
          CASE WHEN coalesce(max_price, 0) < 0 OR coalesce(min_area, 0) < 0 OR coalesce(max_days_old, 0) < 0
                 OR row_limit < 1 OR row_limit > 20 THEN 422 ELSE 200 END AS status FROM ({SEARCHES})),
hits AS (SELECT * FROM (
  SELECT r.request_id, r.row_limit, l.*,
    CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY l.days_old ASC NULLS LAST, l.row_index) AS INTEGER) AS rank
  FROM req r JOIN lst l ON contains(l.district_key, r.k)
    AND (r.max_price IS NULL OR l.price_vnd <= r.max_price)
    AND (r.min_area IS NULL OR l.area_m2 >= r.min_area)
    AND (r.max_days_old IS NULL OR l.days_old <= r.max_days_old)
  WHERE r.status = 200) WHERE rank <= row_limit)"""


def general(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


AGE = f"""CASE WHEN days_old IS NULL THEN '{K.AGE_UNKNOWN}' WHEN days_old = 0 THEN '{K.AGE_TODAY}'
  WHEN days_old = 1 THEN '{K.AGE_YESTERDAY}' ELSE {printf(K.AGE_DAYS, 'days_old')} END"""


def line_amenities(empty: str) -> str:
    return f"CASE WHEN amenities = '' THEN '{empty}' ELSE replace(amenities, '; ', ', ') END"


LINE = f"""id || ' | ' || price_label || ' | ' || {general('area_m2')} || 'm2 | ' || district || ' | ' || {AGE}
  || ' | ' || {line_amenities(K.NO_AMENITY_LINE)}"""
DETAIL = " || chr(10) || ".join(
    f"{lit(label)} || {value}" for label, value in zip(K.DETAIL_LABELS, [
        "id", "title", "price_label", f"{general('area_m2')} || ' m2'", "address",
        line_amenities(K.NO_AMENITY_DETAIL), AGE, "description", "url"])
)
ANSWERS = f"""{SEARCH},
lines AS (SELECT request_id, count(*) AS n, string_agg('  ' || {LINE}, chr(10) ORDER BY rank) AS body
          FROM hits GROUP BY request_id),
answers AS (SELECT r.request_id, n,
  CASE WHEN n > 0 THEN {printf(K.SEARCH_HEADER, 'n')} || chr(10) || body
       ELSE {printf(K.SEARCH_EMPTY, printf(K.SEARCH_EMPTY_FILTER, "coalesce(district, 'None')",
                                             "coalesce(format('{:,}', max_price), 'None')")
            + " || CASE WHEN max_days_old IS NULL THEN '' ELSE " + printf(K.SEARCH_EMPTY_AGE, 'max_days_old') + " END")}
  END AS answer
  FROM req r LEFT JOIN lines USING (request_id) WHERE r.status = 200)"""

# --- slots and bookings -----------------------------------------------------------
_DAY = "TRY_CAST(CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN {c} END AS DATE)"
DAY = _DAY.format(c=strip("date_raw"))
TODAY = f"DATE '{X.TODAY}'"
DATE_ERROR = f"""CASE WHEN {DAY} IS NULL THEN {printf(K.MSG_DATE_FORMAT, 'date_raw')}
  WHEN {DAY} < {TODAY} THEN {printf(K.MSG_DATE_PAST, DAY)}
  WHEN {DAY} > {TODAY} + 30 THEN {printf(K.MSG_DATE_FAR, DAY)} END"""


def number_of(text: str) -> str:
    return f"CAST('0x' || substr(sha256({text}), 1, 8) AS BIGINT)"


def slots(listing: str, day: str) -> str:
    """Offered slots as a list."""
    draw = f"{listing} || ':' || {day}"
    pairs = ", ".join(f"sha256({draw} || ':{s}') || '{s}'" for s in K.SLOT_POOL)
    return f"list_sort(list_transform(list_sort([{pairs}])[1:2 + {number_of(draw)} % 3], lambda x: right(x, 5)))"


def ref(listing: str, day: str, slot: str) -> str:
    draw = f"'booking:' || {listing} || ':' || {day} || ':' || {slot}"
    return f"'BK-' || CAST({number_of(draw)} % 9000 + 1000 AS VARCHAR)"


CHECKED = f"""{LISTINGS},
checked AS (SELECT b.request_id, b.wait_seconds, b.listing_id, b.date_raw, {strip('b.slot')} AS slot, {strip('b.name')} AS name,
   l.id, l.title, l.address, {DATE_ERROR} AS date_error,
   CASE WHEN {DATE_ERROR} IS NULL THEN CAST({DAY} AS VARCHAR) END AS day
  FROM ({BOOKINGS}) b LEFT JOIN latest l ON l.id = {strip('b.listing_id')}),
offered AS (SELECT *, CASE WHEN id IS NOT NULL AND day IS NOT NULL THEN {slots('id', 'day')} END AS pool FROM checked),
winners AS (SELECT id, day, slot, request_id, wait_seconds FROM offered
  WHERE list_contains(pool, slot)
  QUALIFY row_number() OVER (PARTITION BY id, day, slot ORDER BY wait_seconds, request_id) = 1),
day_winners AS (SELECT id, day, list(struct_pack(slot := slot, w := wait_seconds, r := request_id)) AS takers
                FROM winners GROUP BY id, day),
decided AS (SELECT o.*, list_filter(o.pool, lambda s: NOT list_contains(
     list_transform(list_filter(coalesce(d.takers, []), lambda t: t.w < o.wait_seconds OR (t.w = o.wait_seconds AND t.r < o.request_id)),
                    lambda t: t.slot), s)) AS free
  FROM offered o LEFT JOIN day_winners d ON d.id = o.id AND d.day = o.day),
decisions AS (SELECT *, CASE WHEN id IS NULL THEN 404 WHEN day IS NULL THEN 422
     WHEN list_contains(free, slot) THEN 201 ELSE 409 END AS status FROM decided),
answered AS (SELECT request_id, status,
   CASE status WHEN 404 THEN {printf(K.MSG_LISTING_NOT_FOUND, 'listing_id')} WHEN 422 THEN date_error
     WHEN 409 THEN {printf(K.MSG_SLOT_REFUSED, 'slot', f"CASE WHEN len(free) > 0 THEN array_to_string(free, ', ') ELSE '{K.MSG_NO_SLOT_LEFT}' END")}
   END AS error,
   CASE WHEN status = 201 THEN {ref('id', 'day', 'slot')} END AS booking_ref,
   CASE WHEN status = 201 THEN id END AS listing_id, CASE WHEN status = 201 THEN title END AS title,
   CASE WHEN status = 201 THEN address END AS address, CASE WHEN status = 201 THEN day END AS date,
   CASE WHEN status = 201 THEN slot END AS slot, CASE WHEN status = 201 THEN name END AS name
  FROM decisions)"""
OFFERS = f"""offers AS (SELECT DISTINCT {strip('listing_id')} AS listing_id, CAST({DAY} AS VARCHAR) AS date
  FROM ({BOOKINGS}) WHERE {DATE_ERROR} IS NULL)"""
SLOT_ANSWERS = f"""{CHECKED},
taken AS (SELECT listing_id AS id, date AS day, list(slot) AS gone FROM answered WHERE status = 201 GROUP BY 1, 2),
slot_answers AS (SELECT request_id, o.listing_id, date_raw AS date,
   CASE WHEN o.id IS NULL THEN 404 WHEN o.day IS NULL THEN 422 ELSE 200 END AS status,
   CASE WHEN o.id IS NULL THEN {printf(K.MSG_LISTING_NOT_FOUND, 'o.listing_id')} WHEN o.day IS NULL THEN date_error END AS error,
   array_to_string(list_filter(o.pool, lambda s: NOT list_contains(coalesce(t.gone, []), s)), '; ') AS slots
  FROM offered o LEFT JOIN taken t ON t.id = o.id AND t.day = o.day)"""

# --- conversations ------------------------------------------------------------------


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def intent(c: str) -> str:
    return any_of(f"lower({c})", K.BOOKING_INTENT_KEYWORDS)


_Q = strip("question")
SEGMENTS = f"""typed AS (SELECT *, {_Q} AS text,
    CASE WHEN starts_with({_Q}, '/bot') THEN {strip(f'substr({_Q}, 5)')} ELSE {_Q} END AS q FROM ({TURNS})),
flagged AS (SELECT *, (text NOT IN ('/thoat', '/exit', '/quit', '/quen', '/reset', '/gon') AND q <> '') AS is_turn FROM typed),
seg AS (SELECT conv_id, turn, answer, CASE WHEN is_turn THEN q END AS query,
    CASE WHEN is_turn THEN CASE WHEN starts_with(text, '/bot') THEN 'baseline' ELSE 'agent' END END AS mode,
    is_turn AND answer IS NOT NULL AS remembered,
    CAST(sum(CASE WHEN text IN ('/quen', '/reset', '/thoat', '/exit', '/quit') THEN 1 ELSE 0 END)
      OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment_id FROM flagged),
segments AS (SELECT *, CAST(coalesce(sum(CASE WHEN remembered THEN 1 ELSE 0 END) OVER (
    PARTITION BY conv_id, segment_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
  FROM seg)"""
_CUT = f"CASE WHEN length({strip('p.answer')}) > 700 THEN substr({strip('p.answer')}, 1, 700) || ' [...]' ELSE {strip('p.answer')} END"
HISTORIES = f"""{SEGMENTS},
pairs AS (SELECT c.conv_id, c.turn, p.position AS p, p.query AS q, {_CUT} AS a,
    row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY p.position) AS n
  FROM segments c JOIN segments p ON p.conv_id = c.conv_id AND p.segment_id = c.segment_id AND p.remembered
    AND p.position >= c.position - 10 AND p.position < c.position WHERE c.mode IS NOT NULL),
blocks AS (SELECT conv_id, turn, {lit(K.HISTORY_HEADER)} || chr(10)
    || string_agg({printf(K.HISTORY_TURN, 'n', 'q', 'a')}, chr(10) ORDER BY n) || chr(10) AS h FROM pairs GROUP BY 1, 2),
histories AS (SELECT c.conv_id, c.turn, c.mode, c.query, coalesce(h, '') AS history
  FROM segments c LEFT JOIN blocks b USING (conv_id, turn) WHERE c.mode IS NOT NULL)"""

# --- traces ---------------------------------------------------------------------------
_TEXT = "coalesce(raw_output, '')"
OUTPUT = strip(f"regexp_split_to_array({_TEXT}, '\\nObservation[: ]|\\nQuan sát:')[1]")
ACTION = "'(?ms)^\\s*Action:\\s*(\\w+)\\s*\\[(.*)\\]\\s*$'"
TOOL = "nullif(regexp_extract(output, {a}, 1), '')".format(a=ACTION)
ARGS = "CASE WHEN {t} IS NOT NULL THEN regexp_extract(output, {a}, 2) END".format(t=TOOL, a=ACTION)
_TOKENS = """regexp_extract_all(raw_args, '(?:"[^"]*(?:"|\\z)|''[^'']*(?:''|\\z)|[^,"'']+)+')"""
_UNQUOTED = """regexp_replace(t, '"([^"]*)(?:"|\\z)|''([^'']*)(?:''|\\z)', '\\1\\2', 'g')"""
ARG_LIST = (
    f"list_filter(list_transform({_TOKENS}, lambda t: " + strip(f"trim({strip(_UNQUOTED)}, chr(34) || chr(39))")
    + "), lambda t: t <> '')"
)
IS_ERROR = "regexp_matches({c}, '(?i)^\\[[^\\]]*(Error|Exception)[^\\]]*\\]:')"
FINAL = f"CASE WHEN contains(output, 'Final Answer:') THEN {strip('''substr(output, strpos(output, 'Final Answer:') + 13)''')} END"
_NAMES = ", ".join(lit(n) for n, *_ in K.TOOLS)


def _missing(names: list[str]) -> str:
    quoted = [f"'{n}'" for n in names]
    text = quoted[0] if len(names) == 1 else (
        " and ".join(quoted) if len(names) == 2 else ", ".join(quoted[:-1]) + f", and {quoted[-1]}")
    return f"missing {len(names)} required positional argument{'s' if len(names) > 1 else ''}: {text}"


def _faults() -> str:
    cases = []
    for name, required, optional, _, _ in K.TOOLS:
        low, high = len(required), len(required) + len(optional)
        for n in range(low):
            cases.append(f"WHEN tool = '{name}' AND len(args) = {n} THEN {lit(f'{name}() {_missing(required[n:])}')}")
        takes = f"from {low} to {high} positional arguments" if low < high else (
            f"{high} positional argument{'s' if high > 1 else ''}")
        cases.append(f"WHEN tool = '{name}' AND len(args) > {high} THEN "
                     f"'{name}() takes {takes} but ' || CAST(len(args) AS VARCHAR) || ' were given'")
    return "CASE " + " ".join(cases) + " END"


_SIGNATURES = "CASE " + " ".join(f"WHEN tool = '{n}' THEN {lit(n + s)}" for n, _, _, _, s in K.TOOLS) + " END"
CALLS = f"""cut AS (SELECT trace_id, step, question, raw_output, observation, {OUTPUT} AS output FROM ({STEPS}) WHERE step <= 6),
called AS (SELECT *, {TOOL} AS tool, {ARGS} AS raw_args FROM cut),
parsed AS (SELECT *, {ARG_LIST} AS args FROM called),
faulted AS (SELECT *, {_faults()} AS fault FROM parsed),
calls AS (SELECT *, CASE WHEN tool IS NULL THEN NULL WHEN tool NOT IN ({_NAMES}) THEN 'unknown_tool'
    WHEN tool = 'book_viewing' AND NOT {intent('question')} THEN 'write_refused'
    WHEN fault IS NOT NULL THEN 'wrong_arguments' ELSE 'runnable' END AS call_outcome FROM faulted),
refused AS (SELECT *, CASE call_outcome
    WHEN 'unknown_tool' THEN {printf(K.OBS_UNKNOWN_TOOL, 'tool', lit(', '.join(n for n, *_ in K.TOOLS)))}
    WHEN 'write_refused' THEN {lit(K.OBS_WRITE_REFUSED)}
    WHEN 'wrong_arguments' THEN {printf(K.OBS_WRONG_ARGUMENTS, 'tool', 'fault', _SIGNATURES)} END AS refusal FROM calls)"""
# the question at or before the place where a step was asked, with three remembered turns before it
IN_CONVERSATION = f"""{SEGMENTS},
intents AS (SELECT c.conv_id, c.turn, {intent('c.query')} OR coalesce(bool_or({intent('p.query')}), false) AS told
  FROM segments c LEFT JOIN segments p ON p.conv_id = c.conv_id AND p.segment_id = c.segment_id AND p.remembered
    AND p.position >= c.position - 3 AND p.position < c.position
  WHERE c.mode IS NOT NULL GROUP BY c.conv_id, c.turn, c.query),
traced AS (SELECT a.trace_id, coalesce(i.told, false) AS told
  FROM ({ASKED}) a ASOF LEFT JOIN intents i ON a.conv_id = i.conv_id AND a.asked_at >= i.turn),
{CALLS.replace('faulted AS (SELECT *,', f"""meant AS (SELECT parsed.*, {intent('question')} OR told AS intent FROM parsed JOIN traced USING (trace_id)),
faulted AS (SELECT *,""").replace('AS fault FROM parsed)', 'AS fault FROM meant)').replace(f"NOT {intent('question')}", 'NOT intent')}"""
CLASSIFIED = f"""{CALLS},
outcomes AS (SELECT *, {FINAL} AS fin, CASE WHEN {IS_ERROR.format(c=strip('raw_output'))} THEN 'provider_error'
    WHEN contains(output, 'Final Answer:') THEN 'final' ELSE coalesce(call_outcome, 'malformed_action') END AS outcome FROM refused),
classified AS (SELECT *, CASE outcome WHEN 'provider_error' THEN {strip('raw_output')} WHEN 'final' THEN fin END AS answer
  FROM outcomes),
ends AS (SELECT trace_id, min(CASE WHEN outcome IN ('final', 'provider_error') THEN step END) AS last FROM classified GROUP BY 1),
live AS (SELECT c.* FROM classified c JOIN ends e USING (trace_id) WHERE e.last IS NULL OR c.step <= e.last)"""
TRACES = f"""{CLASSIFIED},
traces AS (SELECT trace_id,
    coalesce(max(CASE WHEN outcome IN ('final', 'provider_error') THEN outcome END),
             CASE WHEN count(*) >= 6 THEN 'max_iterations' ELSE 'open' END) AS outcome,
    CAST(count(*) AS INTEGER) AS steps, CAST(count(*) FILTER (outcome = 'runnable') AS INTEGER) AS calls,
    coalesce(max(answer), CASE WHEN count(*) >= 6 THEN {lit(K.MAX_ITERATIONS_TEXT % K.MAX_ITERATIONS)} END) AS answer
  FROM live GROUP BY trace_id)"""
_PATH = ["search_listings", "get_listing_details", "check_viewing_slots", "book_viewing"]


def _subsequence(paths: list[str]) -> str:
    """Names in order somewhere in the comma-joined calls."""
    return "regexp_matches(called, '(^|,)" + "(,|,.*,)".join(paths) + "(,|$)')"


# crawls with clocks of their own, and the rows that come behind the watermark
INGESTED = f"""{LISTINGS},
crawled AS (SELECT * REPLACE ({days('t.posted_ts').replace(NOW, 'crawled_at')} AS days_old), row_index % 89 = 0 AS late
  FROM (SELECT n.*, typed.posted_ts, {NOW} + CASE WHEN n.row_index % 89 = 0 THEN INTERVAL '-2 days'
          ELSE to_hours(CAST(n.row_index % 3 * 6 AS INTEGER)) END AS crawled_at
        FROM norm n JOIN typed ON typed.row_index = n.row_index) t),
told AS (SELECT 'listing' AS kind, * FROM crawled WHERE url = ''
  UNION ALL SELECT 'late', * FROM crawled WHERE url <> '' AND late
  UNION ALL SELECT 'listing', * FROM (SELECT * FROM crawled WHERE url <> '' AND NOT late
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY row_index) = 1))"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


ALL = ("row_index, id, title, price_vnd, price_label, area_m2, district, district_key, address, amenities, "
       "description, posted_at, days_old, url")
CRAWL = ", ".join(f"coalesce({c}_raw, '') AS {c}" for c in ["posted", "title", "price", "area", "address", "descr", "link"])
LEDGER = "booking_ref, listing_id, title, address, date, slot, name"
ROUTES = "CASE " + " ".join(f"WHEN {any_of('lower(question)', ws)} THEN '{n}'" for n, ws in K.ROUTE_RULES) + " ELSE 'unknown' END"
WEEKDAY = "CASE isodow(d) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(K.WEEKDAYS, 1)) + " END"
TEMPLATE = "'Hôm nay là 2026-07-27 (Thứ Hai). Ngày mai là 2026-07-28.'"
BOOKED_TEXT = " || chr(10) || ".join([
    printf(K.BOOKING_LINES[0], "booking_ref"), printf(K.BOOKING_LINES[1], "listing_id", "title"),
    printf(K.BOOKING_LINES[2], "address"), printf(K.BOOKING_LINES[3], "date", "slot"), printf(K.BOOKING_LINES[4], "name")])


def from_steps(select: str) -> str:
    return f"WITH s AS (SELECT trace_id, step, raw_output, {OUTPUT} AS output FROM ({STEPS})) {select}"


ORACLE = {
    "a1_read_listings": f"SELECT {CRAWL} FROM ({RAW})",
    "a2_with_row_index": f"SELECT row_index, {CRAWL} FROM ({RAW})",
    "a3_read_test_cases": """SELECT item_id AS id, 'group ' || CAST(item_id % 7 AS VARCHAR) AS category, text AS question,
        CAST(length(text) AS VARCHAR) AS expected_behavior FROM benchmark""",
    "a4_write_read_normalized": with_listings(f"SELECT {ALL} FROM lst"),
    "a5_append_bookings": with_(CHECKED, f"SELECT {LEDGER} FROM answered WHERE status = 201"),
    "a6_reset_bookings": with_(CHECKED, "SELECT CAST(0 AS BIGINT) AS n_after, count(*) AS n_before FROM answered WHERE status = 201"),
    "b1_strip_accents": from_raw(title=unaccent("title_raw")),
    "b2_district_key": from_raw(key=key("address_raw")),
    "b3_parse_price": from_raw(price_vnd=PRICE),
    "b4_parse_area": from_raw(area_m2=AREA),
    "b5_parse_posted_at": from_raw(posted=f"strftime({POSTED}, '%Y-%m-%d %H:%M')"),
    "b6_extract_amenities": f"SELECT row_index, {amenities('hay')} AS amenities FROM (SELECT row_index, {HAYSTACK} AS hay FROM ({RAW}))",
    "b7_scrub_phones": from_raw(title=mask("title_raw"), descr=mask("descr_raw")),
    "b8_listing_id": from_raw(id=ID),
    "b9_district_of": from_raw(district=DISTRICT),
    "b10_days_old": from_raw(days_old=days(POSTED)),
    "b11_py_strip": from_raw(descr=strip("descr_raw")),
    "b12_iso_timestamp": from_raw(posted_at=iso(POSTED)),
    "b13_normalize": with_listings(f"SELECT {ALL} FROM norm"),
    "b14_validate_date": f"""SELECT request_id, CASE WHEN {DATE_ERROR} IS NULL THEN CAST({DAY} AS VARCHAR) END AS day,
        {DATE_ERROR} AS error FROM ({BOOKINGS})""",
    "c1_drop_without_area": f"SELECT * FROM ({from_raw(area_m2=AREA)}) WHERE area_m2 > 0",
    "c2_drop_junk_price": f"SELECT * FROM ({from_raw(price_vnd=PRICE)}) WHERE price_vnd IS NULL OR price_vnd >= 100000",
    **{
        name: with_listings(f"SELECT row_index, district_key, price_vnd, area_m2, days_old FROM lst WHERE {test}")
        for name, test in {
            "c3_filter_district": "contains(district_key, 'tuliem')", "c4_filter_max_price": "price_vnd <= 3500000",
            "c5_filter_min_area": "area_m2 >= 16.18", "c6_filter_max_days_old": "days_old <= 7"}.items()
    },
    "c7_get_listing": with_listings(f"SELECT {ALL} FROM latest WHERE id = 'pr700081'"),
    "c8_validate_search": with_(SEARCH, "SELECT request_id, row_limit, status FROM req"),
    "d1_dedup_by_link": with_listings(f"SELECT {ALL} FROM lst"),
    "d2_latest_by_id": with_listings(f"SELECT {ALL} FROM latest"),
    "e1_free_slots": with_(CHECKED + ", " + OFFERS, f"""SELECT listing_id, date,
        array_to_string(list_filter({slots('o.listing_id', 'o.date')}, lambda s: NOT list_contains(coalesce(gone, []), s)), '; ') AS free
        FROM offers o LEFT JOIN (SELECT listing_id, date, list(slot) AS gone FROM answered WHERE status = 201 GROUP BY 1, 2) t
        USING (listing_id, date)"""),
    "e2_search_batch": with_(SEARCH, "SELECT request_id, rank, id, price_vnd, area_m2, district, days_old, description FROM hits"),
    "e3_details_batch": with_(CHECKED, f"""SELECT request_id, CASE WHEN l.id IS NULL THEN 404 ELSE 200 END AS status, l.title,
        l.price_vnd, l.url, CASE WHEN l.id IS NULL THEN {printf(K.MSG_LISTING_NOT_FOUND, 'c.listing_id')} END AS error
        FROM checked c LEFT JOIN latest l ON l.id = c.id"""),
    "e4_booking_enrichment": with_(CHECKED, "SELECT request_id, listing_id, title, address FROM answered WHERE status = 201"),
    "f1_listing_count": with_listings("SELECT count(*) AS listings FROM lst"),
    "f2_profile": with_listings("""SELECT count(*) AS total, count(*) FILTER (price_vnd IS NULL) AS without_price,
        count(DISTINCT district) AS districts FROM lst"""),
    "f3_answer_lines": with_(ANSWERS, "SELECT request_id, answer, CAST(n + 1 AS INTEGER) AS n_lines FROM answers WHERE n > 0"),
    "g1_intent_lookback": with_(SEGMENTS, f"""SELECT c.conv_id, c.turn,
        {intent('c.query')} OR coalesce(bool_or({intent('p.query')}), false) AS intent_in_context
        FROM segments c LEFT JOIN segments p ON p.conv_id = c.conv_id AND p.segment_id = c.segment_id AND p.remembered
          AND p.position >= c.position - 3 AND p.position < c.position
        WHERE c.mode IS NOT NULL GROUP BY c.conv_id, c.turn, c.query"""),
    "g2_history_block": with_(HISTORIES, "SELECT conv_id, turn, history FROM histories"),
    "g3_booking_conflicts": with_(CHECKED, "SELECT request_id, status, slot FROM answered WHERE status IN (201, 409)"),
    "g4_session_segments": with_(SEGMENTS, "SELECT conv_id, turn, query, mode, remembered, segment_id, position FROM segments"),
    "g5_transcript_at": with_(CLASSIFIED, """SELECT trace_id, step, 'Câu hỏi: ' || question || chr(10) || coalesce(string_agg(
        output || chr(10) || 'Observation: ' || observation || chr(10), '') OVER (PARTITION BY trace_id ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS transcript FROM live"""),
    "g5_transcript_in_conversation": with_(f"""{HISTORIES}, {CLASSIFIED},
        begun AS (SELECT conv_id, turn, {TEMPLATE} || chr(10) || history || 'Câu hỏi: ' || query || chr(10) AS prompt FROM histories WHERE mode = 'agent'),
        prompted AS (SELECT a.trace_id, b.prompt FROM ({ASKED}) a ASOF LEFT JOIN begun b ON a.conv_id = b.conv_id AND a.asked_at >= b.turn)""",
        f"""SELECT trace_id, step, coalesce(prompt, {TEMPLATE} || chr(10) || 'Câu hỏi: ' || question || chr(10)) || coalesce(string_agg(
        output || chr(10) || 'Observation: ' || observation || chr(10), '') OVER (PARTITION BY trace_id ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS transcript FROM live JOIN prompted USING (trace_id)"""),
    "g6_resolve_attempts": f"""WITH a AS (SELECT *, attempt >= 3 OR NOT ({IS_ERROR.format(c=strip('raw_output'))}
          AND {any_of('lower(raw_output)', [m.lower() for m in K.TRANSIENT_MARKERS])}) AS settled FROM ({ATTEMPTS}))
        SELECT trace_id, step, arg_min(raw_output, attempt) FILTER (settled) AS raw_output,
          min(attempt) FILTER (settled) AS attempt, min(attempt) FILTER (settled) IS NULL AS needs_retry FROM a GROUP BY 1, 2""",
    "h1_order_by_recency": with_listings(
        "SELECT row_index, days_old FROM lst ORDER BY days_old ASC NULLS LAST, row_index"),
    "h2_search": with_listings(f"""SELECT {ALL} FROM lst WHERE contains(district_key, 'caugiay') AND area_m2 >= 15
        ORDER BY days_old ASC NULLS LAST, row_index LIMIT 20"""),
    "h3_top_k_per_request": with_(SEARCH, "SELECT request_id, rank, id FROM hits"),
    "case5_search": with_listings(f"""SELECT row_index, {LINE} AS line FROM (SELECT * FROM lst
        WHERE contains(district_key, 'namtuliem') AND price_vnd <= 4000000 AND days_old <= 7
        ORDER BY days_old ASC NULLS LAST, row_index LIMIT 5)"""),
    "i1_distinct_labels": f"""SELECT row_index, {amenities('hay')} AS amenities,
        CAST(CASE WHEN {amenities('hay')} = '' THEN 0 ELSE len(string_split({amenities('hay')}, '; ')) END AS INTEGER) AS n
        FROM (SELECT row_index, lower({unaccent("title_raw || ' ' || title_raw")}) AS hay FROM ({RAW}))""",
    "i2_free_slots_array": with_(OFFERS, f"""SELECT listing_id, date,
        array_to_string(list_filter({slots('listing_id', 'date')}, lambda s: s NOT IN ('09:00', '14:00')), '; ') AS free FROM offers"""),
    "l1_slots_for": with_(OFFERS, f"SELECT listing_id, date, array_to_string({slots('listing_id', 'date')}, '; ') AS slots FROM offers"),
    "l2_slots_batch": with_(SLOT_ANSWERS, "SELECT * FROM slot_answers"),
    "l3_booking_ref": f"SELECT request_id, {ref('listing_id', 'date_raw', 'slot')} AS booking_ref FROM ({BOOKINGS})",
    "l4_adjudicate": with_(CHECKED, "SELECT * FROM answered"),
    "j1_truncate_at_observation": from_steps("SELECT trace_id, step, output FROM s"),
    "j2_parse_action": from_steps(f"SELECT trace_id, step, {TOOL} AS tool, {ARGS} AS raw_args FROM s"),
    "j3_split_arguments": from_steps(f"""SELECT trace_id, step, CAST(len(a) AS INTEGER) AS n_args, array_to_string(a, '|') AS texts,
        array_to_string(list_transform(a, lambda t: CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN CAST(CAST(t AS BIGINT) AS VARCHAR)
          ELSE '-' END), '|') AS ints
        FROM (SELECT trace_id, step, {ARG_LIST} AS a FROM (SELECT *, {ARGS} AS raw_args FROM s) WHERE raw_args IS NOT NULL)"""),
    "j4_final_answer": from_steps(f"SELECT trace_id, step, {FINAL} AS answer FROM s"),
    "j5_is_provider_error": f"SELECT trace_id, step, attempt, {IS_ERROR.format(c=strip('raw_output'))} AS is_error FROM ({ATTEMPTS})",
    "j6_is_transient": f"""SELECT trace_id, step, attempt, {any_of('lower(raw_output)', [m.lower() for m in K.TRANSIENT_MARKERS])}
        AS transient FROM ({ATTEMPTS})""",
    "j7_has_booking_intent": f"SELECT conv_id, turn, {intent('question')} AS intent FROM ({TURNS})",
    "j8_classify_call": with_(CALLS, "SELECT trace_id, step, tool, call_outcome, refusal FROM refused"),
    "j8_guard_in_conversation": with_(IN_CONVERSATION, "SELECT trace_id, step, tool, intent, call_outcome, refusal FROM refused"),
    "j9_classify_steps": with_(CLASSIFIED, "SELECT trace_id, step, outcome, answer FROM classified"),
    "j10_summarize_traces": with_(TRACES, "SELECT * FROM traces"),
    "j11_route_by_rules": f"SELECT conv_id, turn, {ROUTES} AS route FROM ({TURNS})",
    "j12_date_context": f"""SELECT o_orderkey, CAST(d AS VARCHAR) AS today, {WEEKDAY} AS weekday, CAST(d + 1 AS VARCHAR) AS tomorrow
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "j13_assemble_prompts": with_(HISTORIES, f"""SELECT conv_id, turn, mode, CASE
        WHEN mode = 'agent' THEN {TEMPLATE} || chr(10) || history || 'Câu hỏi: ' || query || chr(10)
        WHEN history <> '' THEN history || 'Câu hỏi: ' || query ELSE query END AS prompt FROM histories"""),
    "k1_age_label": with_listings(f"SELECT row_index, {AGE} AS age FROM lst"),
    "k2_listing_line": with_listings(f"SELECT row_index, {LINE} AS line FROM lst"),
    "k3_render_search": with_(ANSWERS, "SELECT request_id, answer FROM answers"),
    "k4_render_details": with_(CHECKED, f"""SELECT request_id, CASE WHEN l.id IS NULL THEN 404 ELSE 200 END AS status,
        CASE WHEN l.id IS NULL THEN {printf(K.ERROR_TEXT, "'404'", printf(K.MSG_LISTING_NOT_FOUND, 'asked'))} ELSE {DETAIL} END AS answer
        FROM (SELECT request_id, listing_id AS asked, id AS found FROM checked) c LEFT JOIN latest l ON l.id = c.found"""),
    "k5_render_slots": with_(SLOT_ANSWERS, f"""SELECT request_id, status, CASE
        WHEN status <> 200 THEN {printf(K.ERROR_TEXT, 'status', 'error')}
        WHEN slots = '' THEN {printf(K.SLOTS_FULL, 'date', 'listing_id')}
        ELSE {printf(K.SLOTS_FREE, 'date', 'listing_id', "replace(slots, '; ', ', ')")} END AS answer FROM slot_answers"""),
    "k6_render_booking": with_(CHECKED, f"SELECT request_id, status, {BOOKED_TEXT} AS answer FROM answered WHERE status = 201"),
    "k7_render_error": with_(CHECKED, f"""SELECT request_id, {printf(K.ERROR_TEXT, 'status',
        "CASE request_id % 3 WHEN 0 THEN error WHEN 1 THEN error || '; x' ELSE substr(repeat(error, 5), 1, 200) END")} AS answer
        FROM answered WHERE status <> 201"""),
    "k8_fixed_texts": with_(TRACES, """SELECT trace_id, refusal AS text FROM classified WHERE outcome = 'write_refused'
        UNION ALL SELECT trace_id, answer FROM traces WHERE outcome = 'max_iterations'"""),
    "m1_stream_listings": with_(INGESTED, f"SELECT kind, strftime(crawled_at, '%Y-%m-%dT%H:%M:%S') AS crawled, {ALL} FROM told"),
    "m2_stream_bookings": with_(CHECKED, "SELECT * FROM answered"),
    "n1_tool_registry": with_(CALLS, "SELECT t.tool, min_args, max_args, is_write, count(c.tool) AS calls FROM (VALUES "
        + ", ".join(f"('{n}', {len(r)}, {len(r) + len(o)}, {str(w).lower()})" for n, r, o, w, _ in K.TOOLS)
        + ") t(tool, min_args, max_args, is_write) LEFT JOIN calls c ON c.tool = t.tool GROUP BY ALL"),
    "n1_operators": with_listings("""SELECT count(*) AS total, count(*) FILTER (price_vnd IS NULL) AS without_price,
        count(DISTINCT district) AS districts FROM lst"""),
    "o1_check_tool_path": with_(CLASSIFIED, f"""SELECT trace_id, called, CASE trace_id % 3 WHEN 0 THEN {_subsequence(_PATH[:2])}
        WHEN 1 THEN {_subsequence(_PATH)} ELSE {_subsequence(_PATH[2:])} END AS follows_path
        FROM (SELECT trace_id, coalesce(string_agg(tool, ',' ORDER BY step) FILTER (live_call), '') AS called FROM (
          SELECT s.trace_id, l.step, l.tool, coalesce(l.outcome = 'runnable', false) AS live_call
          FROM (SELECT DISTINCT trace_id FROM ({STEPS})) s LEFT JOIN live l USING (trace_id)) GROUP BY trace_id)"""),
    "o2_check_grounding": with_(CLASSIFIED, """SELECT trace_id, array_to_string(list_sort(bad), ',') AS ungrounded, len(bad) = 0 AS grounded
        FROM (SELECT f.trace_id, list_filter(list_distinct(regexp_extract_all(f.answer, 'pr[0-9]+')),
            lambda x: NOT list_contains(coalesce(o.seen, []), x)) AS bad
          FROM (SELECT * FROM live WHERE outcome = 'final') f
          LEFT JOIN (SELECT trace_id, flatten(list(regexp_extract_all(observation, 'pr[0-9]+'))) AS seen
                     FROM live WHERE outcome <> 'final' GROUP BY 1) o USING (trace_id))"""),
    "o3_repeated_actions": with_(CLASSIFIED, """SELECT trace_id, tool, array_to_string(args, '|') AS arguments, CAST(count(*) AS INTEGER) AS times
        FROM live WHERE tool IS NOT NULL AND outcome NOT IN ('final', 'provider_error') GROUP BY trace_id, tool, args HAVING count(*) > 1"""),
    "o4_slot_before_book": with_(CLASSIFIED, """SELECT b.trace_id, b.step, b.args[1] AS listing_id, b.args[2] AS date,
        EXISTS (SELECT 1 FROM live c WHERE c.trace_id = b.trace_id AND c.step < b.step AND c.outcome = 'runnable'
          AND c.tool = 'check_viewing_slots' AND c.args[1] = b.args[1] AND c.args[2] = b.args[2]) AS checked_first
        FROM live b WHERE b.outcome = 'runnable' AND b.tool = 'book_viewing'"""),
    "o5_flag_fabricated": from_steps(f"SELECT trace_id, step, output <> {strip('raw_output')} AS fabricated FROM s"),
    "o6_check_baseline": f"""SELECT run_id, count(*) FILTER (kind = 'model') AS model_calls, count(*) FILTER (kind = 'tool') AS tool_calls,
        count(*) FILTER (kind = 'model') = 1 AND count(*) FILTER (kind = 'tool') = 0 AS clean FROM ({RUNS}) GROUP BY 1""",
}
