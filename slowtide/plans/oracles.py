"""DuckDB texts of the queries in ``registry``, written independently of the Spark plans."""

from slowtide.plans.vocabulary import ANALYSIS_LABELS
from slowtide.sources.testbed import LEXICON, LEXICON_LABELS, generated_lexicon

ORACLES: dict[str, str] = {}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows, columns: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(_quote(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) as (values {body})"


# Derived tables

MESSAGES = """turns as (
  select conv_id, role, turn, text, false as added from conversations
  union all select conv_id, role, turn, null, true from conversations where (conv_id + turn) % 29 = 0),
messages as (
  select conv_id * 1000 + turn + case when added then 500 else 0 end as msg_id, conv_id as thread_id,
         timestamp '2024-01-01 00:00:00' + conv_id * interval '1' day + turn * interval '1' hour as date,
         turn = 0 and not added as is_first_in_thread,
         case when conv_id % 3 = 0 then 'Other' else 'PracticeLogs' end as category,
         role || '_' || cast(conv_id % 7 as varchar) as author,
         'Thread ' || cast(conv_id as varchar) as title,
         text as msg
  from turns)"""
USER_THREADS = MESSAGES.replace("turn = 0 and not added as", "turn = 0 and not added and role <> 'system' as")
OWNERS = """owners as (select thread_id, max_by(author, msg_id) as thread_author
  from messages where is_first_in_thread group by thread_id)"""
LOGS = """logs as (select messages.* from messages join owners using (thread_id)
  where author = thread_author and category = 'PracticeLogs')"""
VECTORS = """vectors as (
  select vec_id as row_id, cast(label % 3 as bigint) as series,
         timestamp '2024-01-01 00:00:00' + vec_id * interval '6' hour
           + cast(floor(vec_id / 50) as bigint) * interval '3' day as date,
         embedding
  from embeddings)"""
LONG_VECTORS = """entries as (select row_id, series, date, cast(generate_subscripts(embedding, 1) - 1 as bigint) as dim,
  cast(unnest(embedding) as double) as v from vectors)"""
PAIRS = """pairs as (select row_id, series, date, list_sum(cast(embedding[:32] as double[])) as x,
  list_sum(cast(embedding[33:] as double[])) as y from vectors)"""
EVENTS = """ev as (select event_id, event_type as series, ts, cast(cast(value as float) as double) as v from events)"""
LABELS = _values(list(enumerate(LEXICON_LABELS)), "label_idx, label", "label_names")


def _split(text: str) -> str:
    return rf"""filter(list_transform(string_split(
      regexp_replace({text}, '([.!?]+["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"""


def _tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}]+'), lambda w: w <> '')"


def _scored(source: str, keys: str, text: str, names: list[str] = LEXICON_LABELS, lists: dict = LEXICON) -> str:
    """CTEs with ``scored``: keys, label_idx, label, score (float) for each non-null text of a source."""
    label_rows = _values(list(enumerate(names)), "label_idx, label", "label_names")
    word_rows = _values([(i, w) for i, x in enumerate(names) for w in lists[x]], "label_idx, word", "words")
    return f"""{label_rows}, {word_rows},
    tokenised as (select {keys}, {text} as t, {_tokens(text)} as tokens from {source} where {text} is not null),
    lists as (select label_idx, list(word) as listed from words group by label_idx),
    shares as (select {keys}, t, label_idx, label,
      len(list_filter(tokens, lambda w: list_contains(listed, w))) / greatest(len(tokens), 1) as share
      from tokenised, lists join label_names using (label_idx)),
    scored as (select {keys}, t, label_idx, label,
      cast(1 / (1 + exp(4.0 * (1 - share) - 4.0 * share)) as float) as score from shares)"""


def _embedded(source: str, keys: str, text: str, dims: int = 16) -> str:
    """CTEs with ``embedded``: keys, dim, value (float) for each non-null text of a source."""
    return f"""tokenised as (select {keys}, unnest(case when len({_tokens(text)}) = 0 then [''] else {_tokens(text)} end) as w
      from {source} where {text} is not null),
    counted as (select {keys}, dim, count(*) filter (where w <> '' and (unicode(w) + unicode(right(w, 1)) * 7 + length(w) * 31) % {dims} = dim) as c
      from tokenised, range({dims}) as d(dim) group by all),
    embedded as (select {keys}, dim,
      cast(c / greatest(sqrt(sum(c * c) over (partition by {keys})), 1.0) as float) as value from counted)"""


def _oracle(name: str, ctes: list[str], select: str) -> None:
    ORACLES[name] = ("with " + ",\n".join(ctes) + "\n" if ctes else "") + select


def _r(x: str) -> str:
    return f"round(cast({x} as double), 6) + 0.0"


# Sources

_oracle("read_messages", [MESSAGES], """select msg_id, thread_id, cast(date as varchar) as date, is_first_in_thread,
  category, author, title, msg from messages""")
_oracle("read_typed_messages", [USER_THREADS, OWNERS], """select msg_id as "msgId", thread_id as "threadId",
  strftime(date, '%Y-%m-%dT%H:%M:%S') as date, is_first_in_thread as "isFirstInThread", category, author, title, msg,
  coalesce(thread_author, 'n/a') as "threadAuthor" from messages left join owners using (thread_id)""")
DOC_SCORES = _scored("(select distinct text from documents)", "text", "text")
_oracle("score_table_upsert", [DOC_SCORES], f"""select label, count(*) as num_texts, {_r('sum(round(cast(score as double), 6))')} as total
  from scored group by label""")
_oracle("vector_table_memo", [_embedded("documents", "doc_id", "text")], f"""select cast(dim as bigint) as dim, count(*) as num_docs,
  {_r('sum(round(cast(value as double), 6))')} as total,
  (select count(distinct text) from documents) as num_encoded from embedded group by dim""")

# Filters, projections, lookups

_oracle("filter_category_author", [MESSAGES], """select msg_id, cast(date as varchar) as date, msg from messages
  where category = 'PracticeLogs' and author = 'user_3'""")
_oracle("own_thread_messages", [MESSAGES, OWNERS], """select msg_id, thread_id, author, category, cast(date as varchar) as date
  from messages join owners using (thread_id) where author = thread_author""")
_oracle("first_messages", [MESSAGES], "select thread_id, author from messages where is_first_in_thread")
_oracle("messages_with_text", [MESSAGES], "select msg_id, msg from messages where msg is not null")
_oracle("append_columns", [VECTORS], "select row_id, series, " + ", ".join(
    f"{_r(f'embedding[{i + 1}]')} as \"V_{i}\"" for i in range(64)) + " from vectors")
_oracle("thread_author_strict", [MESSAGES, OWNERS], """select msg_id, thread_id, author, thread_author
  from messages left join owners using (thread_id)""")
_oracle("thread_author_lenient", [USER_THREADS, OWNERS], """select msg_id, coalesce(thread_author, 'n/a') as thread_author
  from messages left join owners using (thread_id)""")
_oracle("threads_without_author", [USER_THREADS], """select thread_id, count(*) as num_messages from messages
  group by thread_id having not bool_or(is_first_in_thread)""")
_oracle("text_label_pairs", [MESSAGES, _values(list(enumerate(ANALYSIS_LABELS)), "label_idx, label", "all_labels")],
        """select msg_id, cast(label_idx as bigint) as label_idx, 'This example is ' || label || '.' as hypothesis,
  md5(msg || 'This example is ' || label || '.') as pair from messages, all_labels""")
ALL_SCORES = _scored("documents", "doc_id, lang", "text")
CACHE = "cache as (select t, label, max(score) as score from scored where lang = 'en' group by t, label)"
_oracle("score_cache_hits", [ALL_SCORES, CACHE], f"""select doc_id, label, {_r('cache.score')} as score
  from scored join cache using (t, label)""")
_oracle("score_cache_misses", [ALL_SCORES, CACHE], """select label, count(distinct t) as num_texts
  from scored anti join cache using (t, label) group by label""")
_oracle("score_reattach", [ALL_SCORES], f"""select doc_id, cast(label_idx as bigint) as label_idx, {_r('score')} as score from scored""")
_oracle("distinct_texts", [], "select lang, count(distinct text) as num_texts from documents group by lang")

# Aggregates

_oracle("messages_per_author", [MESSAGES], """select author, count(*) as num_posts from messages
  where category = 'PracticeLogs' group by author""")
_oracle("vector_mean", [VECTORS, LONG_VECTORS], f"select series, dim, {_r('avg(v)')} as value from entries group by all")
_oracle("vector_variance", [VECTORS, LONG_VECTORS], f"select series, dim, {_r('var_pop(v)')} as variance from entries group by all")
_oracle("vector_covariance", [VECTORS, LONG_VECTORS], f"""select a.series, count(*) as n, a.dim as i, b.dim as j,
  {_r('covar_samp(a.v, b.v)')} as covariance from entries a join entries b using (row_id) group by a.series, a.dim, b.dim""")
DIFFS = """diffs as (select row_id, series, dim, v, v - lag(v) over (partition by series, dim order by date, row_id) as dv from entries)"""
_oracle("difference_covariance", [VECTORS, LONG_VECTORS, DIFFS], f"""select a.series, count(*) as n, a.dim as i, b.dim as j,
  {_r('covar_samp(a.dv, b.dv)')} as covariance from diffs a join diffs b using (row_id)
  where a.dv is not null group by a.series, a.dim, b.dim""")

# Text and scalars

_oracle("document_sentences", [], f"""select doc_id, cast(generate_subscripts(s, 1) - 1 as bigint) as sentence_idx, unnest(s) as text
  from (select doc_id, {_split('text')} as s from documents)""")
_oracle("document_word_counts", [
    r"""words as (select doc_id, generate_subscripts(w, 1) as place, unnest(w) as word
  from (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents))""",
    r"""cores as (select *, regexp_replace(regexp_replace(word, '^["''(\[{]+', ''), '["'')\]},;:]+$', '') as core from words)""",
    r"""marked as (select *, case when regexp_matches(core, '[!?]$|\.\.$') then '!' when core like '%.' then '.' else '' end as mark,
  lower(regexp_replace(core, '[.!?]+$', '')) as bare, substr(core, 1, 1) as first from cores)""",
    r"""placed as (select *, lag(mark) over (partition by doc_id order by place) as before from marked)""",
    r"""typed as (select *, case when regexp_matches(bare, '^[-+]?[0-9][0-9.,]*$') then '##number##' else bare end as type from placed)"""],
        r"""select type, cast(count(*) filter (where mark = '.') as bigint) as dotted, cast(count(*) filter (where mark <> '.') as bigint) as plain,
  cast(count(*) filter (where first <> lower(first)) as bigint) as uppers,
  cast(count(*) filter (where first = lower(first) and (first <> upper(first) or first = 'ß')) as bigint) as lowers,
  cast(count(*) filter (where before = '.') as bigint) as after_period
  from typed where regexp_matches(type, '[\p{L}\p{N}]') group by type""")
_HOLD = r"'(^|[^\p{L}\p{N}])(la|de)\.(\s)', '\1\2' || chr(2) || '\3', 'g'"
_oracle("message_sentences", [MESSAGES], f"""select msg_id, author, cast(generate_subscripts(s, 1) - 1 as bigint) as sentence_idx,
  replace(unnest(s), chr(2), '.') as msg
  from (select msg_id, author, {_split(f'regexp_replace(regexp_replace(msg, {_HOLD}), {_HOLD})')} as s from messages where msg is not null)""")
_oracle("parse_dates", [MESSAGES], """select msg_id, case when msg is not null then cast(date as varchar) end as date,
  case when msg is not null then cast(cast(date as date) as varchar) end as day from messages""")
_oracle("event_epoch_days", [], f"""select event_id, cast(cast(ts as date) as varchar) as day,
  {_r('epoch_us(ts) / 86400000000.0')} as days from events""")
_oracle("vector_softmax", [VECTORS, LONG_VECTORS], f"""select row_id, dim,
  {_r('exp(v) / sum(exp(v)) over (partition by row_id)')} as value from entries""")
_oracle("entailment_scores", [VECTORS], f"""select row_id,
  {_r('cast(1 / (1 + exp(cast(embedding[1] as double) * 10 - cast(embedding[3] as double) * 10)) as float)')} as score from vectors""")
_oracle("label_lookup", [LABELS], """select vec_id, label_names.label from embeddings join label_names on embeddings.label = label_idx""")

# Time windows and ordered rows

MEAN = _r("cast(avg(v) as float)")
_oracle("tumbling_windows", [EVENTS], f"""select series, cast(date_trunc('day', ts) as varchar) || ' 00:00:00' as window_start,
  count(*) as n, {MEAN} as value from ev group by series, date_trunc('day', ts)""")
ORACLES["tumbling_windows"] = ORACLES["tumbling_windows"].replace(
    "cast(date_trunc('day', ts) as varchar) || ' 00:00:00'", "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')")
FIRST_DAY = "opened as (select *, min(date_trunc('day', ts)) over (partition by series) as first_day from ev)"
_oracle("sliding_windows", [EVENTS, FIRST_DAY, """placed as (select series, v, first_day,
  date_trunc('day', ts) - k * interval '1' day as start from opened, range(7) as r(k))"""],
        f"""select series, strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, {MEAN} as value
  from placed where start >= first_day group by series, start""")
_oracle("sliding_windows_uneven", [EVENTS,
        "steps as (select *, epoch_us(ts) // 172800000000 * 172800000000 as step from ev)",
        "opened as (select *, min(step) over (partition by series) as first_step from steps)",
        "placed as (select series, v, first_step, ts, step - k * 172800000000 as start from opened, range(3) as r(k))"],
        f"""select series, strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, {MEAN} as value
  from placed where start >= first_step and epoch_us(ts) < start + 432000000000 group by series, start""")
_oracle("weekly_windows", [EVENTS], f"""select series, strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') as window_start,
  count(*) as n, {MEAN} as value from ev group by series, date_trunc('week', ts)""")
SCALES = "scaled as (select series, days, epoch_us(ts) // 86400000000 // days * days as bucket, v from ev, range(1, 31) as r(days))"
_oracle("time_scale_grids", [EVENTS, SCALES], f"""select series, cast(days as bigint) as days, cast(bucket as bigint) as window_start,
  count(*) as n, {MEAN} as value from scaled group by series, days, bucket""")
_oracle("pooled_vectors", [VECTORS, LONG_VECTORS,
        "opened as (select *, min(date_trunc('day', date)) over (partition by series) as first_day from entries)",
        """placed as (select series, dim, v, first_day, date_trunc('day', date) - k * interval '1' day as start
  from opened, range(7) as r(k))"""],
        f"""select series, strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, dim, {MEAN} as value
  from placed where start >= first_day group by series, start, dim""")
_oracle("window_texts", [MESSAGES], """select author, strftime(date_trunc('week', date), '%Y-%m-%d %H:%M:%S') as window_start,
  cast(0 as bigint) as part, string_agg(msg, ' ' order by date, msg_id) as msg
  from messages where msg is not null group by author, date_trunc('week', date)""")
_oracle("sliding_window_texts", [MESSAGES,
        """opened as (select *, min(date_trunc('day', date)) over (partition by category) as first_day
  from messages where msg is not null)""",
        "placed as (select *, date_trunc('day', date) - k * interval '1' day as start from opened, range(3) as r(k))"],
        """select category, strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, cast(0 as bigint) as part,
  string_agg(msg, ' ' order by date, msg_id) as msg from placed where start >= first_day group by category, start""")
_oracle("vector_differences", [VECTORS, LONG_VECTORS, DIFFS], f"""select series, row_id, dim, {_r('dv')} as value
  from diffs where dv is not null""")
_oracle("slowness_per_dimension", [VECTORS, LONG_VECTORS, DIFFS], f"""select series, dim,
  {_r('var_samp(dv) / var_samp(v)')} as delta from diffs group by series, dim""")

# Sorting and extremes

_oracle("messages_by_date", [MESSAGES], "select msg_id, cast(date as varchar) as date, author from messages order by date, msg_id")
_oracle("first_windows", [EVENTS, f"""hourly as (select series, date_trunc('hour', ts) as start, count(*) as n, {MEAN} as value
  from ev group by series, start)"""],
        """select series, strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, n, value from hourly
  qualify row_number() over (partition by series order by start) <= 100""")
_oracle("extreme_vectors", [VECTORS, LONG_VECTORS, """ranked as (
  select *, 'high' as side, row_number() over (partition by series, dim order by v desc, row_id) as rank from entries
  union all
  select *, 'low' as side, row_number() over (partition by series, dim order by v, row_id) as rank from entries)"""],
        f"select series, dim as component, side, rank, {_r('v')} as score, row_id from ranked where rank <= 10")

# Models on two dimensions: closed forms for 2 × 2 matrices

SPECTRUM_2D = """halves as (select *, (a + c) / 2 as middle, sqrt(((a - c) / 2) ** 2 + b * b) as radius from mom),
  raw_axes as (select *, 0 as component, middle + radius as variance, b as ux, middle + radius - a as uy from halves
    union all
    select *, 1 as component, middle - radius as variance, a - middle - radius as ux, b as uy from halves),
  axes as (select * exclude (ux, uy),
    ux / sqrt(ux * ux + uy * uy) * sign(case when abs(ux) >= abs(uy) then ux else uy end) as ux,
    uy / sqrt(ux * ux + uy * uy) * sign(case when abs(ux) >= abs(uy) then ux else uy end) as uy from raw_axes)"""
MOMENTS_2D = """mom as (select series, count(*) as n, avg(x) as mx, avg(y) as my,
  var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as c from pairs group by series)"""


def _moments_with_differences(keys: str, order: str) -> str:
    return f"""steps as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from pairs
    window w as (partition by {keys} order by {order})),
  mom as (select {keys}, count(*) as n, avg(x) as mx, avg(y) as my, var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as c,
    var_samp(dx) as da, covar_samp(dx, dy) as db, var_samp(dy) as dc from steps group by {keys})"""


SLOW_2D = """traces as (select *, (c * da - 2 * b * db + a * dc) / (a * c - b * b) as tr,
    (da * dc - db * db) / (a * c - b * b) as det from mom),
  raw_slow as (select *, k as component, greatest(tr / 2 + (2 * k - 1) * sqrt(greatest(tr * tr / 4 - det, 0)), 0) as delta
    from traces, range(2) as r(k)),
  directions as (select *, db - delta * b as ux, delta * a - da as uy from raw_slow),
  slow as (select * exclude (ux, uy),
    ux / sqrt(ux * ux * a + 2 * ux * uy * b + uy * uy * c) * sign(case when abs(ux) >= abs(uy) then ux else uy end) as wx,
    uy / sqrt(ux * ux * a + 2 * ux * uy * b + uy * uy * c) * sign(case when abs(ux) >= abs(uy) then ux else uy end) as wy
    from directions)"""


def _unpivot(name: str, x: str, y: str, more: str) -> str:
    return f"""select series, cast(component as bigint) as component, cast(0 as bigint) as label_idx, {_r(x)} as weight, {more} from {name}
  union all
  select series, cast(component as bigint), cast(1 as bigint), {_r(y)}, {more} from {name}"""


_oracle("pca_of_pairs", [VECTORS, PAIRS, MOMENTS_2D, SPECTRUM_2D],
        _unpivot("axes", "ux", "uy", f"{_r('variance / (a + c)')} as ratio, true as retained"))
_oracle("pca_fraction_of_pairs", [VECTORS, PAIRS, MOMENTS_2D, SPECTRUM_2D], """select series, keep,
  cast(case when variance / (a + c) > keep then 1 else 2 end as bigint) as n_retained
  from axes, (values (cast(0.4 as double)), (cast(0.99 as double))) as k(keep) where component = 0""")
_oracle("pca_columns_of_pairs", [VECTORS, PAIRS, MOMENTS_2D, SPECTRUM_2D], f"""select pairs.series, row_id,
  {_r('max((x - mx) * ux + (y - my) * uy) filter (where component = 0)')} as "PCA_0",
  {_r('max((x - mx) * ux + (y - my) * uy) filter (where component = 1)')} as "PCA_1"
  from pairs join axes using (series) group by pairs.series, row_id""")
_oracle("affine_map_of_pairs", [VECTORS, PAIRS], f"""select row_id, {_r('(x - 0.1) + 2 * (y - 0.2)')} as "Y_0",
  {_r('-0.5 * (x - 0.1) + 3 * (y - 0.2)')} as "Y_1" from pairs""")
BY_DATE = _moments_with_differences("series", "date, row_id")
_oracle("sfa_of_pairs", [VECTORS, PAIRS, BY_DATE, SLOW_2D], _unpivot("slow", "wx", "wy", f"{_r('delta')} as delta"))
_oracle("sfa_columns_of_pairs", [VECTORS, PAIRS, BY_DATE, SLOW_2D], f"""select pairs.series, row_id,
  {_r('max((x - mx) * wx + (y - my) * wy) filter (where component = 0)')} as "SFA_0",
  {_r('max((x - mx) * wx + (y - my) * wy) filter (where component = 1)')} as "SFA_1"
  from pairs join slow using (series) group by pairs.series, row_id""")
# One principal axis may hold more than 99 % of the variance: slowness along it alone
ALONG = "(ux * ux * da + 2 * ux * uy * db + uy * uy * dc) / variance"
_oracle("slowness_of_pairs", [VECTORS, PAIRS, BY_DATE, SPECTRUM_2D, SLOW_2D], f"""select axes.series, axes.n,
  {_r(f'case when variance / (axes.a + axes.c) > 0.99 then {ALONG} else tr end')} as delta
  from axes join traces using (series) where component = 0""".replace("ux * ux * da + 2 * ux * uy * db + uy * uy * dc",
        "ux * ux * axes.da + 2 * ux * uy * axes.db + uy * uy * axes.dc"))
DAILY_SCALES_2D = """day_rows as (select series, epoch_us(date) // 86400000000 as day, x, y from raw_pairs),
  pairs as (select series, days, day // days * days as bucket, cast(cast(avg(x) as float) as double) as x,
    cast(cast(avg(y) as float) as double) as y from day_rows, range(1, 31) as r(days) group by all)"""
_oracle("time_scale_slowness_of_pairs",
        [VECTORS, PAIRS.replace("pairs as", "raw_pairs as", 1), DAILY_SCALES_2D,
         _moments_with_differences("series, days", "bucket"), SPECTRUM_2D, SLOW_2D],
        f"""select axes.series, cast(axes.days as bigint) as days, axes.n,
  {_r('''case when axes.n <= 2 then null when variance / (axes.a + axes.c) > 0.99
    then (ux * ux * axes.da + 2 * ux * uy * axes.db + uy * uy * axes.dc) / variance else delta end''')} as delta
  from axes join slow using (series, days) where axes.component = 0 and slow.component = 0""")
_oracle("time_scale_slowness_of_events", [EVENTS, SCALES,
        "pooled as (select series, days, bucket, cast(cast(avg(v) as float) as double) as v from scaled group by all)",
        "steps as (select *, v - lag(v) over (partition by series, days order by bucket) as dv from pooled)"],
        f"""select series, cast(days as bigint) as days, count(*) as n,
  {_r('case when count(*) > 2 then var_samp(dv) / var_samp(v) end')} as delta from steps group by series, days""")
_oracle("single_label_gain", [EVENTS,
        "pooled as (select series, date_trunc('day', ts) as day, cast(cast(avg(v) as float) as double) as v from ev group by all)",
        "steps as (select *, v - lag(v) over (partition by series order by day) as dv from pooled)"],
        f"""select series, cast(0 as bigint) as label_idx, 'value' as label,
  {_r('2 - var_samp(dv) / var_samp(v)')} as mean_delta_diff from steps group by series""")
_oracle("label_gains_telescope",
        [VECTORS, PAIRS.replace("pairs as", "raw_pairs as", 1),
         """pairs as (select series, date_trunc('day', date) as day, cast(cast(avg(x) as float) as double) as x,
  cast(cast(avg(y) as float) as double) as y from raw_pairs group by all)""",
         _moments_with_differences("series", "day"), SPECTRUM_2D, SLOW_2D],
        f"""select axes.series, cast(iteration as bigint) as iteration,
  {_r('''2 - case when variance / (axes.a + axes.c) > 0.99
    then (ux * ux * axes.da + 2 * ux * uy * axes.db + uy * uy * axes.dc) / variance else delta end''')} as total_gain
  from axes join slow using (series), range(20) as r(iteration) where axes.component = 0 and slow.component = 0""")
_oracle("amplitude_spectra", [
        "hourly as (select event_type as series, date_trunc('hour', ts) as start, avg(value) as v from events group by all)",
        """placed as (select series, v, row_number() over (partition by series order by start) - 1 as t,
  count(*) over (partition by series) as n from hourly)""",
        """waves as (select series, k, n, sum(v * cos(2 * pi() * ((k * t) % n) / n)) as re, sum(v * sin(2 * pi() * ((k * t) % n) / n)) as im
  from placed, (select unnest(range(400)) as k) where k < n // 2 group by series, k, n)"""],
        f"""select series, cast(k as bigint) as k, {_r('k / n')} as frequency, {_r('2 / n * sqrt(re * re + im * im)')} as amplitude,
  {_r('case when k > 0 then n / k end')} as period, k = 0 as endless from waves""")

# Label analyses on given matrices

MATRIX = """long as (select label as component, generate_subscripts(embedding, 1) - 1 as label_idx, cast(unnest(embedding) as double) as v from embeddings),
  matrix as (select component, label_idx, avg(v) as weight from long group by all)"""
_oracle("matrix_label_weights", [MATRIX, _values(list(enumerate(ANALYSIS_LABELS)), "label_idx, label", "label_names")], f"""select cast(component as bigint) as component,
  row_number() over (partition by component order by weight, label_idx) as position, label, {_r('weight')} as weight
  from matrix join label_names using (label_idx)""")
_oracle("matrix_product", [MATRIX], f"""select cast(a.component as bigint) as component, cast(b.label_idx as bigint) as label_idx,
  {_r('sum(a.weight * b.weight)')} as weight from matrix a join matrix b on a.label_idx = b.component group by a.component, b.label_idx""")
_oracle("matrix_label_importance", [MATRIX, "ratios as (select component, sum(abs(weight)) as ratio from matrix group by component)"],
        f"""select cast(label_idx as bigint) as label_idx, {_r('max(abs(sqrt(ratio) * weight))')} as importance
  from matrix join ratios using (component) group by label_idx""")
_oracle("matrix_temporal_importance", [MATRIX,
        "deltas as (select component, sum(abs(weight)) * 10 as delta, sqrt(sum(weight * weight)) as length from matrix group by component)",
        "variances as (select label_idx, var_pop(v) as variance from long group by label_idx)"],
        f"""select cast(label_idx as bigint) as label_idx, {_r('max(abs(weight / length * greatest(2 - delta, 0)))')} as importance,
  {_r('any_value(variance)')} as variance from matrix join deltas using (component) join variances using (label_idx) group by label_idx""")

# Scoring

MESSAGE_VECTORS = _embedded("messages", "msg_id", "msg")
_oracle("message_embeddings", [MESSAGES, MESSAGE_VECTORS], f"select msg_id, cast(dim as bigint) as dim, {_r('value')} as value from embedded")
MESSAGE_SCORES = _scored("messages", "msg_id", "msg")
_LABEL_VECTORS = f"select msg_id, cast(label_idx as bigint) as dim, {_r('score')} as value from scored"
_oracle("label_vectors", [MESSAGES, MESSAGE_SCORES], _LABEL_VECTORS)
_oracle("memoised_label_scores", [MESSAGES, MESSAGE_SCORES], _LABEL_VECTORS)
_oracle("label_score_table", [MESSAGES,
        f"""sentences as (select msg_id, cast(generate_subscripts(s, 1) - 1 as bigint) as sentence_idx, unnest(s) as msg
  from (select msg_id, {_split('msg')} as s from messages where msg is not null))""",
        _scored("sentences", "msg_id, sentence_idx", "msg")],
        f"select msg_id, sentence_idx, t as msg, label, {_r('score')} as score from scored".replace("t as msg, ", ""))
_oracle("memoised_scores", [_scored("documents", "doc_id, lang", "text"),
        """texts as (select t, bool_or(lang = 'en') as english from scored where label_idx = 0 group by t)"""],
        f"""select label, count(*) as num_docs, {_r('sum(round(cast(score as double), 6))')} as total,
  (select count(*) from texts where english) as scored_first, (select count(*) from texts where not english) as scored_second,
  cast(0 as bigint) as scored_third from scored group by label""")

# End-to-end analyses

PER_AUTHOR = """per_author as (select author, count(*) as num_posts, cast(cast(min(date) as date) as varchar) as first_date,
  cast(cast(max(date) as date) as varchar) as last_date from logs group by author)"""
_oracle("practice_log_counts", [MESSAGES, OWNERS, LOGS, PER_AUTHOR], "select * from per_author")
_oracle("top_practice_log_authors", [MESSAGES, OWNERS, LOGS, PER_AUTHOR],
        "select * from per_author order by num_posts desc, author limit 10")
_oracle("practice_logs_of_author", [MESSAGES, OWNERS, LOGS], """select msg_id, thread_id, cast(date as varchar) as date,
  is_first_in_thread, category, author, title, msg from logs where author = 'user_3'""")
WEEKLY_LOGS = [MESSAGES, OWNERS, LOGS, _embedded("logs", "msg_id, author, date", "msg"),
               """weekly as (select author, date_trunc('week', date) as start, count(distinct msg_id) as n, dim,
  cast(avg(cast(value as double)) as float) as value from embedded group by author, start, dim)"""]
_oracle("time_aggregated_logs", WEEKLY_LOGS, f"""select author, strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, n,
  cast(dim as bigint) as dim, {_r('value')} as value from weekly""")
_oracle("time_aggregated_texts", [MESSAGES, OWNERS, LOGS], """select author,
  strftime(date_trunc('week', date), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, cast(0 as bigint) as part,
  string_agg(msg, ' ' order by date, msg_id) as msg from logs where msg is not null group by author, date_trunc('week', date)""")
_oracle("weekly_authors_sketched", [MESSAGES], """select category, strftime(date_trunc('week', date), '%Y-%m-%d') as week,
  count(distinct author) as num_authors from messages group by all""")
_oracle("collection_profile", [MESSAGES, OWNERS, LOGS], """select (select count(*) from messages) as num_rows,
  (select count(*) from messages where category = 'PracticeLogs') as num_category_rows,
  (select count(distinct author) from messages where category = 'PracticeLogs') as num_category_authors,
  (select count(*) from logs where author = 'user_3') as num_own_thread_posts""")
_oracle("category_top_authors", [MESSAGES], """select author, count(*) as num_posts from messages where category = 'PracticeLogs'
  group by author order by num_posts desc, author limit 10""")

# Batch interfaces

_oracle("batch_encoder_vectors", [MESSAGES], "\nunion all\n".join(
    f"select msg_id, cast({i} as bigint) as dim, {_r(f"length(msg) - length(replace(lower(msg), '{c}', ''))")} as value from messages where msg is not null"
    for i, c in enumerate("aeiou")))
_COUNTS = ", ".join(f"length(msg) - length(replace(lower(msg), '{c}', '')) as {c}" for c in "xyz")
_oracle("batch_class_probabilities", [MESSAGES, f"counts as (select msg_id, {_COUNTS} from messages where msg is not null)",
        "tops as (select *, greatest(x, y, z) as top from counts)"], "\nunion all\n".join(
    f"select msg_id, cast({i} as bigint) as dim, {_r(f'cast(exp({c} - top) / (exp(x - top) + exp(y - top) + exp(z - top)) as float)')} as value from tops"
    for i, c in enumerate("xyz")))
_oracle("batch_pair_scores", [MESSAGES, "gaps as (select msg_id, (length(replace(msg, 'e', '')) - length(replace(msg, 'a', ''))) / 8.0 as gap from messages where msg is not null)"],
        f"select msg_id, cast(d as bigint) as dim, {_r('cast(1 / (1 + exp(cast(gap as double))) as float)')} as value from gaps, range(3) as r(d)")

# Memo

LOG_SENTENCES = f"""sentences as (select msg_id, author, date, cast(generate_subscripts(s, 1) - 1 as bigint) as sentence_idx, unnest(s) as msg
  from (select msg_id, author, date, {_split('msg')} as s from logs where msg is not null))"""
_oracle("memoised_analyses", [MESSAGES, OWNERS, LOGS, LOG_SENTENCES], f"""select 'texts' as kind, count(distinct msg) as scored_first,
  cast(0 as bigint) as scored_second from logs where msg is not null
  union all
  select 'pairs', {len(LEXICON_LABELS)} * count(distinct msg), 0 from sentences""")
_oracle("label_scores_of_all_labels", [MESSAGES, _scored("messages", "msg_id", "msg", ANALYSIS_LABELS, generated_lexicon(ANALYSIS_LABELS))], _LABEL_VECTORS)
_oracle("score_rows_after_upserts", [MESSAGES, _scored("(select distinct msg from messages)", "msg", "msg", LEXICON_LABELS[:2])],
        f"select md5(t) as text_md5, label, {_r('cast(score + 1 as float)')} as score from scored")

# Full width

_oracle("pca_restores_covariance", [VECTORS, LONG_VECTORS], f"""select a.series, a.dim as i, b.dim as j,
  {_r('covar_samp(a.v, b.v)')} as covariance from entries a join entries b using (row_id) group by a.series, a.dim, b.dim""")
_oracle("sfa_restores_difference_covariance", [VECTORS, LONG_VECTORS, DIFFS], f"""select a.series, a.dim as i, b.dim as j,
  {_r('covar_samp(a.dv, b.dv)')} as covariance from diffs a join diffs b using (row_id)
  where a.dv is not null group by a.series, a.dim, b.dim""")

# Two dimensions of which one or both may be flat: a feature is left only along the axis that varies, the rest is zero
SLOW_2D_FLAT = """tops as (select *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) as top, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) as low from mom),
  ranks as (select *, case when n < 2 or top <= 1e-15 then 0 when low <= 1e-12 * top then 1 else 2 end as rank,
    case when abs(b) < 1e-14 then case when a >= c then 1.0 else 0.0 end else b / sqrt(b * b + (top - a) ** 2) end as ax,
    case when abs(b) < 1e-14 then case when a >= c then 0.0 else 1.0 end else (top - a) / sqrt(b * b + (top - a) ** 2) end as ay from tops),
  known as (select * exclude (da, db, dc), case when n > 2 then da else 0 end as da, case when n > 2 then db else 0 end as db,
    case when n > 2 then dc else 0 end as dc from ranks),
  traces as (select *, (c * da - 2 * b * db + a * dc) / nullif(a * c - b * b, 0) as tr,
    (da * dc - db * db) / nullif(a * c - b * b, 0) as det from known),
  raw_slow as (select *, k as component, case rank when 2 then greatest(tr / 2 + (2 * k - 1) * sqrt(greatest(tr * tr / 4 - det, 0)), 0)
    when 1 then case when k = 0 then (ax * ax * da + 2 * ax * ay * db + ay * ay * dc) / top else 0 end else 0 end as delta
    from traces, range(2) as r(k)),
  directions as (select *, case when rank = 2 then db - delta * b when rank = 1 and component = 0 then ax else 0 end as ux,
    case when rank = 2 then delta * a - da when rank = 1 and component = 0 then ay else 0 end as uy from raw_slow),
  slow as (select * exclude (ux, uy),
    coalesce(ux / nullif(sqrt(ux * ux * a + 2 * ux * uy * b + uy * uy * c), 0) * sign(case when abs(ux) >= abs(uy) then ux else uy end), 0) as wx,
    coalesce(uy / nullif(sqrt(ux * ux * a + 2 * ux * uy * b + uy * uy * c), 0) * sign(case when abs(ux) >= abs(uy) then ux else uy end), 0) as wy
    from directions)"""

# Analyses with two places

TWO_PLACES = _embedded("logs", "msg_id, author, date", "msg", 2)
BY_AUTHOR = lambda order: [
    x.replace("series", "author") for x in (_moments_with_differences("series", order), SPECTRUM_2D, SLOW_2D)]


def _pooled(start: str, source: str = "embedded") -> str:
    return f"""pairs as (select author, {start} as start, count(distinct msg_id) as n_rows,
  cast(cast(avg(cast(value as double)) filter (where dim = 0) as float) as double) as x,
  cast(cast(avg(cast(value as double)) filter (where dim = 1) as float) as double) as y from {source} group by author, {start})"""


_oracle("author_slowness_of_two_places",
        [MESSAGES, OWNERS, LOGS, TWO_PLACES, _pooled("date_trunc('week', date)"), *BY_AUTHOR("start")],
        f"""select axes.author, axes.n, {_r('''case when axes.n <= 2 then null when variance / (axes.a + axes.c) > 0.99
    then (ux * ux * axes.da + 2 * ux * uy * axes.db + uy * uy * axes.dc) / variance else delta end''')} as delta
  from axes join slow using (author) where axes.component = 0 and slow.component = 0""")
_oracle("slow_features_of_two_places",
        [MESSAGES, OWNERS, LOGS, TWO_PLACES,
         "opened as (select *, min(date_trunc('day', date)) over (partition by author) as first_day from embedded)",
         "spread as (select *, date_trunc('day', date) - k * interval '1' day as day from opened, range(7) as r(k))",
         "placed as (select * from spread where day >= first_day)", _pooled("day", "placed"), _moments_with_differences("author", "start"), SLOW_2D_FLAT],
        f"""select pairs.author, strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, n_rows as n,
  {_r('max((x - mx) * wx + (y - my) * wy) filter (where component = 0)')} as "SFA_0",
  {_r('max((x - mx) * wx + (y - my) * wy) filter (where component = 1)')} as "SFA_1"
  from pairs join slow using (author) group by pairs.author, start, n_rows""")
_oracle("typical_sentences_of_two_places",
        [MESSAGES, OWNERS, LOGS, LOG_SENTENCES, _embedded("sentences", "msg_id, sentence_idx, author", "msg", 2),
         """pairs as (select author, msg_id, sentence_idx, max(cast(value as double)) filter (where dim = 0) as x,
    max(cast(value as double)) filter (where dim = 1) as y from embedded group by author, msg_id, sentence_idx)""",
         MOMENTS_2D.replace("series", "author"), SPECTRUM_2D.replace("series", "author"),
         """scores as (select p.author, p.msg_id, p.sentence_idx, case when a + c > 0 then (x - mx) * ux + (y - my) * uy else 0 end as score
    from pairs p join axes on p.author = axes.author and component = 0)""",
         """ends as (select *, 'high' as side, row_number() over (partition by author order by score desc, msg_id, sentence_idx) as rank from scores
    union all select *, 'low', row_number() over (partition by author order by score, msg_id, sentence_idx) from scores)"""],
        f"""select author, cast(0 as bigint) as component, side, rank, {_r('score')} as score, msg_id, sentence_idx, msg
  from ends join sentences using (author, msg_id, sentence_idx) where rank <= 20""")
_oracle("time_scale_slowness_of_two_places",
        [MESSAGES, OWNERS, LOGS, TWO_PLACES,
         """scaled as (select author, days, epoch_us(date) // 86400000000 // days * days as bucket, dim, value from embedded, range(1, 31) as r(days)),
  pairs as (select author, days, bucket, cast(cast(avg(cast(value as double)) filter (where dim = 0) as float) as double) as x,
    cast(cast(avg(cast(value as double)) filter (where dim = 1) as float) as double) as y from scaled group by author, days, bucket)""",
         _moments_with_differences("author, days", "bucket"), SPECTRUM_2D, SLOW_2D],
        f"""select axes.author, cast(axes.days as bigint) as days, axes.n,
  {_r('''case when axes.n <= 2 then null when variance / (axes.a + axes.c) > 0.99
    then (ux * ux * axes.da + 2 * ux * uy * axes.db + uy * uy * axes.dc) / variance else delta end''')} as delta
  from axes join slow using (author, days) where axes.component = 0 and slow.component = 0""")
_oracle("label_gains_of_two_labels",
        [MESSAGES, OWNERS, LOGS, LOG_SENTENCES, _scored("sentences", "msg_id, author, date", "msg", LEXICON_LABELS[:2]),
         """pairs as (select author, date_trunc('day', date) as start,
  cast(cast(avg(cast(score as double)) filter (where label_idx = 0) as float) as double) as x,
  cast(cast(avg(cast(score as double)) filter (where label_idx = 1) as float) as double) as y from scored group by all)""",
         *BY_AUTHOR("start")],
        f"""select axes.author, {_r('''2 - case when axes.n < 2 or axes.a + axes.c = 0 then 2 when axes.n = 2 then 0 when variance / (axes.a + axes.c) > 0.99
    then (ux * ux * axes.da + 2 * ux * uy * axes.db + uy * uy * axes.dc) / variance else delta end''')} as total_gain
  from axes join slow using (author) where axes.component = 0 and slow.component = 0""")

# Hash-based orders and vectors

_oracle("mock_embeddings", [MESSAGES], f"""select msg_id, cast(i as bigint) as dim,
  {_r("cast(('0x' || substr(md5('0:' || msg_id || ':' || i), 1, 13)) as bigint) / 4503599627370496.0")} as value from messages, range(10) as r(i)""")
_oracle("label_permutations", [], f"""select doc_id as iteration, cast(i as bigint) as label_idx,
  row_number() over (partition by doc_id order by md5('0:' || doc_id || ':' || i)) - 1 as position from documents, range({len(LEXICON_LABELS)}) as r(i)""")

# Smoothing of one or two points: matrices of order two

_oracle("smoothed_pairs", [EVENTS,
        """daily as (select series, epoch_us(date_trunc('day', ts)) / 86400000000.0 as day, cast(cast(avg(v) as float) as float) / 100 as y
  from ev group by series, date_trunc('day', ts))""",
        """points as (select series, cast(floor(day / 2) as bigint) as block, day, cast(y as double) as y from daily)""",
        """blocks as (select series, block, count(*) as n, min(day) as t, min_by(y, day) as y1, max_by(y, day) as y2,
  case when count(*) = 2 then exp(-0.5 * ((max(day) - min(day)) / 10.0) ** 2) end as e from points group by series, block)""",
        """fits as (select *, power(10.0, -3 + a / 10.0) as amp, power(10.0, -3 + a / 10.0) + 1 as d from blocks, range(61) as r(a)),
  solved as (select *, case when n = 2 then d * d - amp * amp * e * e else d end as det from fits),
  scored as (select *, -0.5 * (case when n = 2 then (d * y1 * y1 - 2 * amp * e * y1 * y2 + d * y2 * y2) / det else y1 * y1 / d end
    + ln(det) + n * ln(2 * pi())) as fit from solved),
  best as (select * from scored qualify row_number() over (partition by series, block order by fit desc, a) = 1)""",
        """curve as (select series, block, day,
    case when n = 1 then amp * y1 / d when day = t
      then (amp * (d * y1 - amp * e * y2) + amp * e * (d * y2 - amp * e * y1)) / det
      else (amp * e * (d * y1 - amp * e * y2) + amp * (d * y2 - amp * e * y1)) / det end as mean,
    case when n = 1 then amp / d else amp - (amp * amp * d - 2 * amp * amp * e * amp * e + amp * amp * e * e * d) / det end as variance
  from points join best using (series, block))"""],
        f"""select series, block, {_r('day')} as day, cast(10.0 as double) as length_scale, {_r('mean')} as mean,
  {_r('mean - 1.96 * sqrt(greatest(variance, 0))')} as lower, {_r('mean + 1.96 * sqrt(greatest(variance, 0))')} as upper from curve""")

# The slowness analysis with two labels

TWO_LABELS = [MESSAGES, OWNERS, LOGS, LOG_SENTENCES, _scored("sentences", "msg_id, sentence_idx, author, date", "msg", LEXICON_LABELS[:2]),
    """pairs as (select author, msg_id, sentence_idx, any_value(date) as date, max(cast(score as double)) filter (where label_idx = 0) as x,
  max(cast(score as double)) filter (where label_idx = 1) as y from scored group by author, msg_id, sentence_idx)""",
    MOMENTS_2D.replace("series", "author"), SPECTRUM_2D.replace("series", "author")]
# a series without variance has shares 0 and nothing retained, and so no weights; beyond the rank likewise
_SHARES = """retention as (select *, case when a + c > 0 then variance / (a + c) else 0 end as ratio,
    coalesce(a + c > 0 and variance > 1e-12 * max(variance) over (partition by author), false) as retained from axes)"""
_LABELLED = """labelled as (select author, component, ratio, 0 as label_idx, ux as weight from retention where retained
    union all select author, component, ratio, 1, uy from retention where retained)"""
_oracle("two_label_explained_variance", [*TWO_LABELS, _SHARES],
        f"select author, cast(component as bigint) as component, {_r('ratio')} as ratio, retained from retention")
_oracle("two_label_weights_of_pca", [*TWO_LABELS, _SHARES, _LABELLED], f"""select author, cast(component as bigint) as component,
  row_number() over (partition by author, component order by weight, label_idx) as position, cast(label_idx as bigint) as label_idx,
  label, {_r('weight')} as weight from labelled join label_names using (label_idx)""")
_oracle("two_label_importance", [*TWO_LABELS, _SHARES, _LABELLED], f"""select author, cast(label_idx as bigint) as label_idx,
  {_r('max(abs(sqrt(ratio) * weight))')} as importance, label from labelled join label_names using (label_idx) group by author, label_idx, label""")
TWO_LABEL_SLOW = [*[c.replace("pairs as (", "sentence_pairs as (").replace("from pairs", "from sentence_pairs") for c in TWO_LABELS[:-2]],
        *[c.replace("mom as (", "sentence_mom as (").replace("from mom", "from sentence_mom").replace("from pairs", "from sentence_pairs")
          .replace("halves", "sentence_halves").replace("raw_axes", "sentence_raw_axes").replace(" axes as (", " sentence_axes as (") for c in TWO_LABELS[-2:]],
        """projected as (select p.author, p.date, min(date_trunc('day', p.date)) over (partition by p.author) as first_day,
    (x - k.mx) * k.ux + (y - k.my) * k.uy as u, (x - l.mx) * l.ux + (y - l.my) * l.uy as v
  from sentence_pairs p join sentence_axes k on p.author = k.author and k.component = 0
    join sentence_axes l on p.author = l.author and l.component = 1),
  placed as (select *, date_trunc('day', date) - k * interval '1' day as start from projected, range(7) as r(k)),
  pairs as (select author, start, cast(cast(avg(u) as float) as double) as x, cast(cast(avg(v) as float) as double) as y
    from placed where start >= first_day group by author, start
    qualify row_number() over (partition by author order by start) <= 800)""",
        _moments_with_differences("author", "start"), SLOW_2D_FLAT]
_oracle("two_label_deltas", TWO_LABEL_SLOW,
        f"select author, cast(component as bigint) as component, {_r('delta')} as delta from slow")
_oracle("two_label_pca_weights_in_sfa", TWO_LABEL_SLOW, f"""select author, cast(component as bigint) as component,
  cast(0 as bigint) as pca_component, {_r('coalesce(wx / nullif(sqrt(wx * wx + wy * wy), 0), 0)')} as weight from slow
  union all select author, cast(component as bigint), cast(1 as bigint), {_r('coalesce(wy / nullif(sqrt(wx * wx + wy * wy), 0), 0)')} from slow""")
