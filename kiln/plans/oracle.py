"""DuckDB SQL equal in meaning to each registered query (the correctness
oracle). Views come from ``kiln.sources.fixtures``; string rules are inlined
as SQL text (Python-whitespace strip, scrub, clean, details rendering)."""

from __future__ import annotations

from kiln.config import NA_TOKENS
from kiln.operators.scoring import init_head
from kiln.sources.fixtures import duck_ctes, render

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NWS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def scrub(e: str) -> str:
    return strip(f"replace(replace(replace({e}, chr(9), ' '), chr(10), ' '), chr(13), '')")


def missing(e: str) -> str:
    return f"(coalesce({strip(e)}, '') = '')"


def urls(l: str) -> str:
    return f"coalesce(array_to_string(list_filter({l}, lambda x: x is not null and x <> ''), ' | '), '')"


def details_text(d: str) -> str:
    path = """'$."' || k || '"'"""
    typ, raw = f"json_type(json_extract({d}, {path}))", f"cast(json_extract({d}, {path}) as varchar)"
    # Nested values of the views hold no quotes, colons or commas in strings.
    nested = raw
    for old, new in (('"', "''"), (":", ": "), (",", ", "), ("true", "True"), ("false", "False"), ("null", "None")):
        nested = f"replace({nested}, '{old}', '{new}')"
    value = (f"case {typ} when 'NULL' then 'None' when 'BOOLEAN' then upper(left({raw}, 1)) || substr({raw}, 2) when 'OBJECT' then {nested} "
             f"when 'ARRAY' then {nested} else json_extract_string({d}, {path}) end")
    entry = strip(f"replace(concat(k, ': ', {value}), ';', ' ')")
    keys = f"list_filter(json_keys({d}), lambda k, i: list_position(json_keys({d}), k) = i)"
    return (f"case when {d} is null then '' when not json_valid({d}) then {d} "
            f"when json_type({d}) <> 'OBJECT' then {d} "
            f"else coalesce(array_to_string(list_transform({keys}, lambda k: {entry}), ' | '), '') end")


def features_text(e: str) -> str:
    return (f"coalesce(array_to_string(list_transform(list_filter({e}, lambda x: x is not null), "
            f"lambda x: {strip(chr(114) + 'eplace(x, ' + chr(39) + '|' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')}), ' | '), '')")


def description_text(e: str) -> str:
    return (f"coalesce(array_to_string(list_transform(list_filter({e}, lambda x: x is not null), "
            f"lambda x: {strip('x')}), ' '), '')")


def clean(e: str) -> str:
    x = f"replace(replace({e}, '\\''', ''), '\\\"', '')"
    x = f"regexp_replace({x}, '(?i)(https?://{NWS}+|www\\.{NWS}+)', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^\\n]*?>', ' ', 'g')"
    x = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return strip(x)


NORM = f"""select item_id, category, {scrub('main_category')} as main_category, {scrub('title')} as title,
  average_rating, rating_number,
  {scrub(features_text('features'))} as features,
  {scrub(description_text('description'))} as description,
  {urls('hi_res')} as images_hi_res, {urls('large')} as images_large, {urls('videos')} as video_urls,
  {scrub(details_text('details'))} as details
from raw"""

KEPT = f"""select * from norm
where not ({missing('main_category')} or {missing('title')} or {missing('features')} or {missing('description')})
  and average_rating is not null and not isnan(average_rating) and rating_number is not null
  and length({strip("concat(title, ' ', features, ' ', description)")}) > 30
  and not ({missing('images_hi_res')} and {missing('images_large')})"""

SEED, FRAC, MIN_SAMPLES, RARE, BATCH, WARMUP, CAP, MAX_LEN = 42, 0.2, 12, 24, 32, 5, 40, 256


def hash_order(id_expr: str, seed=SEED) -> str:
    return f"md5('{seed}:' || cast({id_expr} as varchar))"


SAMPLED = f"""select * exclude (rn, n) from (
  select *, row_number() over (partition by category order by {hash_order('item_id')}, item_id) as rn,
         count(*) over (partition by category) as n from kept) s
where rn <= least(n, greatest(cast(floor(n * cast({FRAC} as double)) as bigint), {MIN_SAMPLES}))"""

STRATA = f"""select k.*, case when c.vc <= {RARE} then 'RARE' else cast(k.average_rating as varchar) end as strat_label
from kept k join (select average_rating, count(*) as vc from kept group by 1) c using (average_rating)"""

QUOTAS = """q0 as (select strat_label, count(*) as c from strata group by 1),
q1 as (select *, sum(c) over () as n, min(c) over () as minc from q0),
q2 as (select *, n - cast(ceil(n * cast(0.2 as double)) as bigint) as n_train from q1),
q3 as (select *, cast(floor(c * n_train / n) as bigint) as fl, (c * n_train) % n as rem from q2),
q4 as (select *, n_train - sum(fl) over () as need,
              row_number() over (order by rem desc, strat_label) as rr from q3),
q5 as (select strat_label, c, fl + case when rr <= need then 1 else 0 end as q_train from q4),
q6 as (select *, c - q_train as t, sum(c - q_train) over () as tn from q5),
q7 as (select *, tn - cast(ceil(tn * cast(0.5 as double)) as bigint) as n_val from q6),
q8 as (select *, case when tn = 0 then 0 else cast(floor(t * n_val / tn) as bigint) end as fl2,
              case when tn = 0 then 0 else (t * n_val) % tn end as rem2 from q7),
q9 as (select *, n_val - sum(fl2) over () as need2,
              row_number() over (order by rem2 desc, strat_label) as rr2 from q8),
quotas as (select strat_label, q_train, fl2 + case when rr2 <= need2 then 1 else 0 end as q_val from q9)"""

SPLIT = f"""select s.*, case when rn <= q_train then 'train' when rn <= q_train + q_val then 'val' else 'test' end as split
from (select *, row_number() over (partition by strat_label order by {hash_order('item_id')}, item_id) as rn from strata) s
join quotas using (strat_label)"""


def with_views(*names: str, extra: str = "") -> str:
    base = [n for n in names if n in ("raw", "raw_whole", "texts", "predictions", "history", "timings", "manifest", "models", "images")]
    parts = [f"{n} as ({render(n, 'duckdb')})" for n in base]
    derived = {"norm": NORM, "kept": KEPT, "sampled": SAMPLED, "strata": STRATA}
    for n in names:
        if n in derived:
            parts.append(f"{n} as ({derived[n]})")
        if n == "quotas":
            parts.append(QUOTAS)
        if n == "split":
            parts.append(f"split as ({SPLIT})")
    if extra:
        parts.append(extra)
    return "with " + ",\n".join(parts) + "\n"


PREP = ("raw", "norm", "kept")

# Antialiased resize of three probe pixels (top left, centre, bottom right):
# integer weights under a triangle, along the rows, then along the columns,
# rounded to 8 bits each time; pixel bytes cycle through the vector's values.
RASTERS = f"""with img as (
  select vec_id, case when vec_id % 20 = 3 then 230 + vec_id % 90 when vec_id % 20 = 4 then 300 else 10 + vec_id % 7 end as h,
    case when vec_id % 13 = 0 then 9 when vec_id % 20 = 3 then 240 + vec_id % 320 else 12 + vec_id % 5 end as w,
    [1, 3, 4][label % 3 + 1] as ch,
    list_transform(embedding, lambda x: least(255, greatest(0, floor((cast(x as double) + 1.0) * 127.5)))) as px from embeddings),
use as (select * from img where vec_id % 11 <> 0 and w >= 10 and h >= 10),
probe(name, o) as (values ('tl', 0), ('c', 111), ('br', 223)),
lens as (select distinct n from (select h as n from use union select w from use)),
axis as (select n, o, (o + 0.5) * (n / 224.0::double) as centre, greatest(n / 224.0::double, 1.0) as reach from lens, probe),
taps as (select n, o, x, greatest(0, 1 - abs((x - centre + 0.5) / reach)) as k from (
  select *, unnest(range(cast(greatest(0, floor(centre - reach + 0.5)) as bigint), cast(least(n, floor(centre + reach + 0.5)) as bigint))) as x from axis)),
wt as (select n, o, x, cast(floor(0.5 + k / sum(k) over (partition by n, o) * 4194304) as bigint) as k from taps),
flat as (select u.vec_id, name, c, ty.x as y, ty.k as ky,
    least(255, greatest(0, floor((sum(tx.k * px[((ty.x * w + tx.x) * ch + case when ch = 1 then 0 else c end) % 64 + 1]) + 2097152) / 4194304))) as v
  from use u, probe p, (select unnest([0, 1, 2]) as c), wt ty, wt tx
  where ty.n = u.h and ty.o = p.o and tx.n = u.w and tx.o = p.o group by all),
done as (select vec_id, name, c, least(255, greatest(0, floor((sum(ky * v) + 2097152) / 4194304))) as v from flat group by all),
every as (select vec_id, name, c from img, probe, (select unnest([0, 1, 2]) as c)),
val as (select e.vec_id, [('b', 0.406, 0.225), ('g', 0.456, 0.224), ('r', 0.485, 0.229)][e.c + 1] as s, e.name,
    coalesce(v, 0) / 255.0::double as v from every e left join done d on d.vec_id = e.vec_id and d.name = e.name and d.c = e.c),
out as (select vec_id, s[1] || '_' || name as col, round(cast(cast((v - s[2]::double) / s[3]::double as float) as double), 6) as v from val)
select vec_id, cast(150528 as bigint) as n_values,
{", ".join(f"max(v) filter (col = '{c}_{n}') as {c}_{n}" for c in "rgb" for n in ("tl", "c", "br"))}
from out group by vec_id"""


def r6(e: str) -> str:
    return f"round(cast({e} as double), 6)"


def size(e: str) -> str:
    return f"cast(case when {e} is null then -1 else len({e}) end as integer)"


TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s\x0b\x1c-\x1f\x{85}\p{Z}]"

DOC_LEN = f"""select doc_id, lang, cast(least(coalesce(len(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')), 0) + 2, {MAX_LEN}) as bigint) as L
  from documents"""

TOKENS = f"""toks as (select doc_id, unnest(tk) as token, generate_subscripts(tk, 1) - 1 as pos
  from (select doc_id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') as tk from documents)),
vocab as (select token, cnt, cast(row_number() over (order by cnt desc, token) + 3 as integer) as token_id
  from (select token, count(*) as cnt from toks group by token)),
enc as (select d.doc_id, 2 + count(t.pos) as n_ids,
  '2' || coalesce(string_agg(' ' || cast(coalesce(v.token_id, 1) as varchar), '' order by t.pos), '') || ' 3' as ids
  from documents d left join toks t on t.doc_id = d.doc_id and t.pos < {MAX_LEN - 2}
  left join vocab v on v.token = t.token group by d.doc_id)"""

BATCHES = f"""bt as (select doc_id, n_ids, cast(floor((row_number() over (order by doc_id) - 1) / {BATCH}) as bigint) as batch_id
  from enc),
bb as (select batch_id, count(*) as n_samples, min(doc_id) as first_item, max(n_ids) as padded_len,
  sum(n_ids) as tokens from bt group by batch_id)"""

CANDS = """case when images_hi_res is null or images_hi_res = '' then cast([] as varchar[])
  else string_split(images_hi_res, ' | ') end || case when images_large is null or images_large = '' then cast([] as varchar[])
  else string_split(images_large, ' | ') end"""

ATTACH = f"""att as (select k.item_id, coalesce(i.origin, '') as images, i.origin is not null as has_images
  from kept k left join (select origin from images where width >= 10 and height >= 10) i
  on i.origin = ({CANDS})[1])"""

REPORT = f"""m as (select * from timings where batch_idx >= {WARMUP} and batch_idx < {WARMUP + CAP}),
rep as (select run_id, first(device) as device, count(*) as measured_batches, cast(sum(batch_size) as bigint) as num_samples,
  cast(sum(tokens) as bigint) as num_input_tokens, sum(end_us - start_us) / 1e6 as model_seconds,
  (max(end_us) - min(start_us)) / 1e6 as end_to_end_seconds,
  max(case when device like 'cuda%' then alloc_bytes end) / 1048576.0 as peak_alloc_mib,
  max(case when device like 'cuda%' then reserved_bytes end) / 1048576.0 as peak_reserved_mib
  from m group by run_id)"""


def pearson(x="prediction", y="label") -> str:
    return (f"case when count({x}) >= 2 and stddev_pop({x}) > 0 and stddev_pop({y}) > 0 "
            f"then covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) else 0.0 end")


def smooth_l1(x="prediction", y="label") -> str:
    return f"case when abs({x} - {y}) < 1.0 then 0.5 * abs({x} - {y}) * abs({x} - {y}) / 1.0 else abs({x} - {y}) - 0.5 end"


def block_flops(L: str, d: str = "384", m: str = "4") -> str:
    L, d, m = f"cast({L} as double)", f"cast({d} as double)", f"cast({m} as double)"
    return f"(3.0 * {L} * {d} * {d} + 1.0 * {L} * {d} * {d} + 2.0 * {L} * {L} * {d} + 2.0 * {L} * {d} * ({m} * {d}))"


def model_flops(L: str, with_images: str = "true") -> str:
    head = "cast(2 * 1664 * 512 + 2 * 512 * 256 + 2 * 256 * 1 as double)"
    img = "390000000.0 * (224.0 * 224.0) / 50176.0"
    return f"((6.0 * {block_flops(L, '384', '4')} + case when {with_images} then {img} else 0.0 end + {head}) * 1.0)"


def resource_cost(p: str, f: str) -> str:
    return f"(pow(cast({p} as double) / 1e9, 0.5) * pow(cast({f} as double) / 20e9, 0.5))"


def eff(C: str) -> str:
    return (f"case when {C} <= 1.0 then least(1.0 + 0.05 * ln(1.0 / greatest({C}, 1e-12)), 1.1) "
            f"else 1.0 / (1.0 + 2.0 * ln({C})) end")


def best_stop(patience: int) -> str:
    return with_views("history", extra=f"""h1 as (select *, max(case when not isnan(val_plcc) then val_plcc end) over (partition by run_id order by epoch
      rows between unbounded preceding and 1 preceding) as pm from history),
h2 as (select *, not isnan(val_plcc) and (pm is null or val_plcc > pm) as imp from h1),
h3 as (select *, epoch - coalesce(max(case when imp then epoch end) over (partition by run_id order by epoch
      rows between unbounded preceding and current row), 0) as since from h2),
st as (select run_id, min(case when since >= {patience} then epoch end) as stop_epoch from h3 group by run_id),
bst as (select h3.run_id, max(h3.epoch) as best_epoch from h3 join st using (run_id)
        where imp and (st.stop_epoch is null or h3.epoch <= st.stop_epoch) group by h3.run_id)""") + """
select st.run_id, cast(bst.best_epoch as bigint) as best_epoch, round(h.val_plcc, 6) as best_val_plcc,
  cast(st.stop_epoch as bigint) as stop_epoch
from st left join bst using (run_id) left join history h on h.run_id = st.run_id and h.epoch = bst.best_epoch"""


def weighted_preds() -> str:
    return ("wm as (select avg(ln(1 + coalesce(rating_number, 0))) as ml from predictions),\n"
            "wp as (select p.*, least(case when (select ml from wm) > 0 then ln(1 + coalesce(p.rating_number, 0)) / (select ml from wm) "
            "else 1.0 end, 5.0) as weight from predictions p)")


def _numbers(v) -> str:
    return "[" + ", ".join(f"{float(x):.17e}" for x in v) + "]"


def _erf_sql(x: str, terms: int = 150) -> str:
    """erf by its series of positive terms 2^n x^(2n+1) / (2n+1)!!, times
    2 / sqrt(pi) * exp(-x^2); 1 beyond 6."""
    c, cs = 1.0, []
    for n in range(terms):
        cs.append(c)
        c *= 2.0 / (2 * n + 3)
    return (f"(case when abs({x}) >= 6 then sign({x}) else 2 / sqrt(pi()) * exp(-{x} * {x}) * {x} * "
            f"list_sum(list_transform({_numbers(cs)}, lambda c, n: c * pow({x} * {x}, n - 1))) end)")


def _layer_sql(src: str, out: str, w, bias) -> str:
    """CTEs of linear -> layer norm (unit gain, no shift) -> GELU over the
    table ``src`` (vec_id, x); ``w`` holds one list of weights per output."""
    rows = ", ".join(f"({j}, {_numbers(w[:, j])}, {float(bias[j]):.17e})" for j in range(w.shape[1]))
    return f"""{out}_w(j, w, b) as (values {rows}),
{out}_lin as (select vec_id, j, list_dot_product(x, w) + b as v from {src}, {out}_w),
{out}_mv as (select vec_id, avg(v) as m, var_pop(v) as s from {out}_lin group by vec_id),
{out}_n as (select vec_id, j, (v - m) / sqrt(s + 1e-5) as v from {out}_lin join {out}_mv using (vec_id)),
{out}_e as (select vec_id, j, v, v / sqrt(2) as z from {out}_n),
{out} as (select vec_id, list(0.5 * v * (1 + {_erf_sql('z')}) order by j) as x from {out}_e group by vec_id)"""


def head_score_sql(p: dict) -> str:
    """The scoring head over the gated and fused vectors of ``embeddings``; the
    seeded weights are written out."""
    return f"""with fused as (select vec_id, list_concat(
    list_transform(embedding[1:32], lambda x: cast(x as double) * case when label % 2 = 0 then 1 else 0 end),
    list_transform(embedding[33:64], lambda x: cast(x as double))) as x from embeddings),
{_layer_sql('fused', 'h1', p['w1'], p['b1'])},
{_layer_sql('h1', 'h2', p['w2'], p['b2'])}
select vec_id, round(list_dot_product(x, {_numbers(p['w3'][:, 0])}) + {float(p['b3'][0]):.17e}, 6) as score from h2"""


HISTORY = f"""hs as (select *, case when id % 5 < 4 then 'train' else 'val' end as split from wp),
tr as (select run_id, epoch, sum(weight * ({smooth_l1()})) / count(*) as train_loss, {pearson()} as train_plcc,
   stddev_pop(prediction) as train_std_pred, stddev_pop(label) as train_std_label from hs where split = 'train' group by 1, 2),
va as (select run_id, epoch, avg({smooth_l1()}) as val_loss, avg(abs(prediction - label)) as val_mae,
   sqrt(sum((prediction - label) * (prediction - label)) / greatest(count(*), 1)) as val_rmse, {pearson()} as val_plcc,
   stddev_pop(prediction) as val_std_pred, stddev_pop(label) as val_std_label from hs where split = 'val' group by 1, 2),
hist as (select tr.*, va.val_loss, va.val_plcc, va.val_mae, va.val_rmse, va.val_std_pred, va.val_std_label,
   2e-5 * tr.epoch as lr from tr join va using (run_id, epoch))"""

KEPT_COLS = ("item_id, category, main_category, title, features, description, details, images_hi_res, images_large, "
             "video_urls, round(average_rating, 6) as average_rating, cast(rating_number as bigint) as rating_number")

NA_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


def _na(c: str) -> str:
    return f"case when coalesce({c}, '') in ({NA_LIST}) then null else {c} end"


ORACLE: dict[str, str] = {
    "S1_partitioned_union": with_views("raw") + f"""select item_id, category, main_category, title,
  round(average_rating, 6) as average_rating, cast(rating_number as bigint) as rating_number,
  {size('features')} as n_features, {size('hi_res')} as n_hi_res, {size('videos')} as n_videos from raw""",
    "S2_select_fields": with_views("raw") + "select item_id, category, 11 as n_columns, details from raw",
    "S3_S5_csv_keep_empty": with_views(*PREP) + "select item_id, category, coalesce(main_category, '') as main_category, "
        "coalesce(title, '') as title, features, description, details, images_hi_res, images_large, video_urls, "
        "round(average_rating, 6) as average_rating, cast(rating_number as bigint) as rating_number from kept",
    "S4_csv_default_na": with_views(*PREP) + f"""select item_id, {_na('category')} as category, {_na('main_category')} as main_category,
  {_na('title')} as title, {_na('features')} as features, {_na('description')} as description, {_na('details')} as details,
  {_na('images_hi_res')} as images_hi_res, {_na('images_large')} as images_large, {_na('video_urls')} as video_urls,
  round(average_rating, 6) as average_rating, cast(rating_number as bigint) as rating_number from kept""",
    "S6_cached_stage": with_views(*PREP) + "select item_id, category, title from kept",
    "S7_image_dir": """with img as (
  select vec_id, 'd' || (vec_id % 3) || '/v+ ' || vec_id || '.png' as image_path, vec_id % 11 <> 0 and vec_id % 17 <> 5 as decoded,
    cast(case when vec_id % 20 = 3 then 230 + vec_id % 90 when vec_id % 20 = 4 then 300 else 10 + vec_id % 7 end as integer) as h,
    cast(case when vec_id % 13 = 0 then 9 when vec_id % 20 = 3 then 240 + vec_id % 320 else 12 + vec_id % 5 end as integer) as w,
    [1, 3, 4][label % 3 + 1] as ch,
    array_to_string(list_transform(embedding, lambda x: printf('%02X', cast(least(255, greatest(0, floor((cast(x as double) + 1.0) * 127.5))) as integer))), '') as hex64
  from embeddings)
select vec_id, image_path, decoded, case when decoded then h end as height, case when decoded then w end as width,
  case when decoded then ch end as channels, case when decoded then md5(left(repeat(hex64, h * w * ch // 64 + 1), 2 * h * w * ch)) end as pixels_md5
from img""",
    "S8_json_report": with_views("timings", extra=REPORT) + """select run_id, measured_batches, num_samples,
  round(end_to_end_seconds, 6) as end_to_end_seconds from rep""",
    "S9_history_append": with_views("predictions", extra=weighted_preds() + ",\n" + HISTORY) + """select run_id,
  cast(epoch as bigint) as epoch, round(train_loss, 6) as train_loss, round(val_plcc, 6) as val_plcc from hist""",
    "N1_field_defaults": with_views("raw") + "select item_id, '' as main_category, title, cast(null as double) as average_rating from raw",
    "N2_features_text": with_views("raw_whole") + f"select item_id, {features_text('features')} as features from raw_whole",
    "N3_description_text": with_views("raw") + f"select item_id, {description_text('description')} as description from raw",
    "N4_image_urls": with_views("raw") + f"select item_id, {urls('hi_res')} as images_hi_res, {urls('large')} as images_large from raw",
    "N5_video_urls": with_views("raw") + f"select item_id, {urls('videos')} as video_urls from raw",
    "N6_details": with_views("raw") + f"select item_id, {details_text('details')} as details from raw",
    "N7_scrub": with_views("raw_whole") + f"select item_id, {scrub('main_category')} as main_category, {scrub('title')} as title from raw_whole",
    "N_normalize": with_views("raw", "norm") + """select item_id, category, main_category, title, features, description,
  images_hi_res, images_large, video_urls, details, round(average_rating, 6) as average_rating,
  cast(rating_number as bigint) as rating_number from norm""",
    "N8_cast": with_views(*PREP) + "select item_id, title, round(average_rating, 6) as average_rating, "
        "round(cast(rating_number as double), 6) as rating_number from kept",
    "N9_relabel": with_views(*PREP) + "select item_id, category as main_category from kept",
    "F1_missing": with_views("raw", "norm") + f"""select item_id, {missing('main_category')} as miss_main_category,
  {missing('title')} as miss_title, {missing('features')} as miss_features, {missing('description')} as miss_description,
  (average_rating is null or isnan(average_rating)) as miss_average_rating, rating_number is null as miss_rating_number from norm""",
    "F2_required": with_views("raw", "norm") + f"""select item_id from norm
  where not ({missing('main_category')} or {missing('title')} or {missing('features')} or {missing('description')}
  or average_rating is null or isnan(average_rating) or rating_number is null)""",
    "F3_long_enough": with_views("raw", "norm") + f"""select item_id,
  cast(length({strip("concat_ws(' ', title, features, description)")}) as bigint) as combined_len,
  coalesce(length({strip("concat_ws(' ', title, features, description)")}) > 30, false) as passes from norm""",
    "F4_has_image": with_views("raw", "norm") + f"select item_id, not ({missing('images_hi_res')} and {missing('images_large')}) as has_image_urls from norm",
    "F_kept": with_views(*PREP) + f"select {KEPT_COLS} from kept",
    "F5_valid_entries": with_views("raw_whole", extra=f"norm as ({NORM.replace('from raw', 'from raw_whole')})") + f"select item_id, title from norm where not {missing('title')} "
        "and average_rating is not null and not isnan(average_rating)",
    "F6_accounting": with_views("raw", "norm", extra=f"""v as (select *, (not {missing('title')} and average_rating is not null
      and not isnan(average_rating)) as valid,
      ({clean('title')} is distinct from title or {clean('features')} is distinct from features
       or {clean('description')} is distinct from description or {clean('details')} is distinct from details) as changed from norm)""") +
        """select cast(count_if(valid) as bigint) as kept, cast(count(*) as bigint) as total,
  cast(count_if(not valid) as bigint) as dropped, cast(count_if(valid and changed) as bigint) as modified from v""",
    "C1_quotes": with_views("texts") + "select item_id, replace(replace(t, '\\''', ''), '\\\"', '') as t from texts",
    "C2_urls": with_views("texts") + f"select item_id, regexp_replace(t, '(?i)(https?://{NWS}+|www\\.{NWS}+)', ' ', 'g') as t from texts",
    "C3_tags": with_views("texts") + "select item_id, regexp_replace(t, '<[^\\n]*?>', ' ', 'g') as t from texts",
    "C4_whitespace": with_views("texts") + f"select item_id, {strip(chr(114) + 'egexp_replace(t, ' + chr(39) + WS + '+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} as t from texts",
    "C_clean_text": with_views("texts") + f"select item_id, {clean('t')} as t from texts",
    "C5_C6_clean_columns": with_views("raw", "norm", extra=f"""v as (select * from norm where not {missing('title')}
      and average_rating is not null and not isnan(average_rating))""") + f"""select item_id, {clean('title')} as title,
  {clean('features')} as features, {clean('description')} as description, {clean('details')} as details,
  ({clean('title')} is distinct from title or {clean('features')} is distinct from features
   or {clean('description')} is distinct from description or {clean('details')} is distinct from details) as text_changed from v""",
    "C7_first_change": with_views("raw", "norm", extra=f"""v as (select item_id, title, features, description, details,
      {clean('title')} as c_title, {clean('features')} as c_features, {clean('description')} as c_description,
      {clean('details')} as c_details from norm where not {missing('title')} and average_rating is not null
      and not isnan(average_rating)),
f as (select * from v where c_title is distinct from title or c_features is distinct from features
      or c_description is distinct from description or c_details is distinct from details order by item_id limit 1),
u as (select item_id, 0 as pos, 'title' as "column", title as before, c_title as after from f
      union all select item_id, 1, 'features', features, c_features from f
      union all select item_id, 2, 'description', description, c_description from f
      union all select item_id, 3, 'details', details, c_details from f)""") +
        'select item_id, cast(pos as integer) as pos, "column", before, after from u where before is distinct from after',
    "P1_sample": with_views(*PREP, "sampled") + "select item_id, category from sampled",
    "P2_rare_strata": with_views(*PREP, "strata") + "select item_id, strat_label from strata",
    "P3_P4_split": with_views(*PREP, "strata", "quotas", "split") + "select item_id, strat_label, split from split",
    "P5_split_sizes": with_views(*PREP, "strata", "quotas", "split") + "select split, count(*) as n from split group by split",
    "P6_shuffle": with_views(*PREP, "strata", "quotas", "split") + f"""select item_id,
  row_number() over (order by md5('{SEED}:1:' || cast(item_id as varchar)), item_id) - 1 as row_ord
  from split where split = 'train'""",
    "T1_product_text": with_views(*PREP, "sampled") + f"""select item_id, concat_ws(chr(10),
  case when not {missing("category")} then 'Main category: ' || category end,
  case when not {missing('title')} then 'Title: ' || title end,
  case when not {missing('features')} then 'Features: ' || features end,
  case when not {missing('description')} then 'Description: ' || description end,
  case when not {missing('details')} then 'Details: ' || details end) as text from sampled""",
    "T2_sample_text": with_views(*PREP, extra=f"na as (select item_id, {', '.join(f'{_na(c)} as {c}' for c in ('main_category', 'title', 'features', 'description'))} from kept)") + f"""select item_id, concat_ws(chr(10),
  case when not {missing("main_category")} then 'Main category: ' || main_category end,
  case when not {missing('title')} then 'Title: ' || title end,
  case when not {missing('features')} then 'Features: ' || features end,
  case when not {missing('description')} then 'Description: ' || description end) as text from na""",
    "T3_text_stats": with_views(*PREP, "sampled", extra=f"""tx as (select concat_ws(chr(10),
  case when not {missing("category")} then 'Main category: ' || category end,
  case when not {missing('title')} then 'Title: ' || title end,
  case when not {missing('features')} then 'Features: ' || features end,
  case when not {missing('description')} then 'Description: ' || description end,
  case when not {missing('details')} then 'Details: ' || details end) as text from sampled)""") +
        "select round(avg(length(text)), 6) as mean_len, cast(min(length(text)) as bigint) as min_len, "
        "cast(max(length(text)) as bigint) as max_len from tx",
    "T4_vocabulary": "with " + TOKENS + "\nselect token, cast(cnt as bigint) as cnt, token_id from vocab",
    "T4_token_ids": "with " + TOKENS + "\nselect doc_id as item_id, cast(n_ids as bigint) as n_ids, ids from enc",
    "T5_T7_batches": "with " + TOKENS + ",\n" + BATCHES + """
select batch_id, cast(n_samples as bigint) as n_samples, first_item, cast(padded_len as bigint) as padded_len,
  cast(n_samples * padded_len as bigint) as padded_total from bb""",
    "T6_token_counts": "with " + TOKENS + ",\n" + BATCHES + """
select batch_id, cast(n_samples as bigint) as samples, cast(tokens as bigint) as tokens,
  round(tokens / n_samples, 6) as tokens_per_sample from bb""",
    "I1_candidates": with_views(*PREP) + f"select item_id, array_to_string(({CANDS})[1:2], ';') as candidates from kept",
    "I2_local_paths": with_views(*PREP) + f"""select item_id, array_to_string(list_filter(list_transform(
  string_split(concat_ws(' ; ', replace(images_hi_res, ' | ', ';'), ' ', images_large), ';'), lambda x: {strip('x')}),
  lambda x: x <> '')[1:2], ';') as paths from kept""",
    "I3_attach": with_views(*PREP, "images", extra=ATTACH) + "select item_id, images, has_images from att",
    "I4_valid_size": with_views("images") + "select origin, width >= 10 and height >= 10 as valid from images",
    "I5_has_images": with_views(*PREP, "images", extra=ATTACH) +
        "select item_id, case when has_images then 1.0 else 0.0 end as has_images from att",
    "I6_I7_rasters": RASTERS,
    "W1_mean_log_count": with_views(*PREP, "strata", "quotas", "split") +
        "select round(avg(ln(1 + coalesce(cast(rating_number as double), 0))), 6) as mean_log_count from split where split = 'train'",
    "W2_weights": with_views(*PREP, "strata", "quotas", "split") + """, wm as (select avg(ln(1 + coalesce(cast(rating_number as double), 0))) as ml
  from split where split = 'train')
select item_id,
  round(least(case when (select ml from wm) > 0 then ln(1 + coalesce(cast(rating_number as double), 0)) / (select ml from wm)
  else 1.0 end, 5.0), 6) as weight from split""",
    "W3_label_defaults": with_views(*PREP) + "select item_id, 0.0::double as label, "
        "round(coalesce(cast(rating_number as double), 0.0), 6) as rating_number from kept",
    "A1_category_counts": with_views(*PREP, "sampled") + """select category as main_category, count(*) as "count",
  round(count(*) * cast(100 as double) / sum(count(*)) over (), 6) as percentage from sampled group by category""",
    "A2_rating_counts": with_views("raw", "norm") + """select round(average_rating, 6) as average_rating, count(*) as "count",
  round(count(*) * cast(100 as double) / sum(count(*)) over (), 6) as percentage from norm where average_rating is not null
  group by average_rating""",
    "A3_column_profile": with_views("raw", "norm") + """select * from (
  select 0 as position, 'item_id' as "column", count(item_id) as non_null, 'bigint' as dtype from norm
  union all select 1, 'main_category', count(main_category), 'string' from norm
  union all select 2, 'title', count(title), 'string' from norm
  union all select 3, 'average_rating', count(average_rating), 'double' from norm
  union all select 4, 'rating_number', count(rating_number), 'bigint' from norm
  union all select 5, 'details', count(details), 'string' from norm)""",
    "A4_first_row": with_views("raw", "norm", extra="f as (select * from norm order by item_id limit 1)") + """
select 0 as position, 'item_id' as "column", cast(item_id as varchar) as value from f
union all select 1, 'main_category', main_category from f
union all select 2, 'title', title from f
union all select 3, 'average_rating', cast(average_rating as varchar) from f
union all select 4, 'rating_number', cast(rating_number as varchar) from f
union all select 5, 'details', details from f""",
    "M1_gate": """select vec_id, round(list_sum(list_transform(embedding[1:32], lambda x: cast(x * (case when label % 2 = 0 then 1.0 else 0.0 end) as double))), 6) as gated_sum
from embeddings""",
    "M2_fuse": """select vec_id, cast(64 as bigint) as dim,
  round(cast(embedding[1] as double) * case when label % 2 = 0 then 1.0 else 0.0 end, 6) + 0.0 as first,
  round(cast(embedding[64] as double), 6) + 0.0 as last from embeddings""",
    "M4_clamp": with_views("predictions") + "select id, round(case when isnan(prediction) then prediction else greatest(1.0, least(5.0, prediction)) end, 6) as score from predictions",
    "M5_submission": with_views("predictions") + """select cast(id as varchar) as item_id,
  printf('%.2f', greatest(1.0, least(5.0, cast(cast(prediction as float) as double)))) as score,
  '1.0' as params, '1.8' as flops from predictions""",
    "M6_summary": with_views("predictions") + """select count(*) as n, round(min(greatest(1.0, least(5.0, prediction))), 6) as min_score,
  round(max(greatest(1.0, least(5.0, prediction))), 6) as max_score, 0.0::double as seconds_per_row from predictions""",
    "M7_fit_to_convergence": """with recursive d as materialized (
  select label, embedding[1]::double as x, 10 * embedding[2]::double as y, 1.0::double + vec_id % 3 as w from embeddings),
fit as (
  select label, 0 as it, 0.0::double as a, 0.0::double as b from d group by label
  union all
  select label, it + 1, (sw * sxy - sx * sy) / (sw * sxx - sx * sx), (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) from (
    select d.label, it, sum(k) as sw, sum(k * x) as sx, sum(k * y) as sy, sum(k * x * x) as sxx, sum(k * x * y) as sxy
    from (select d.label, it, x, y, case when it = 0 then w else w / greatest(1.0, abs(a * x + b - y)) end as k
          from d join fit on d.label = fit.label where it < 400) d group by d.label, it))
select label, (select count(*) from d where d.label = fit.label) as n, round(a, 4) as coef, round(b, 4) as intercept, true as flat, true as converged
from fit where it = 400""",
    "V1_smooth_l1": with_views("predictions") + f"select id, round({smooth_l1()}, 6) as loss from predictions",
    "V2_loss_mae_rmse": with_views("predictions") + f"""select cast(run_id as bigint) as run_id, round(avg({smooth_l1()}), 6) as loss,
  round(avg(abs(prediction - label)), 6) as mae, round(sqrt(sum((prediction - label) * (prediction - label)) / count(*)), 6) as rmse
  from predictions group by run_id""",
    "V3_pearson": with_views("predictions") + f"select run_id, round({pearson()}, 6) as plcc from predictions group by run_id",
    "V4_pearson_safe": with_views("predictions") + f"""select run_id, epoch, round(case when isnan({pearson()}) then 0.0 else {pearson()} end, 6) as plcc
  from predictions group by run_id, epoch""",
    "V5_std": with_views("predictions") + """select run_id, round(stddev_pop(prediction), 6) as std_pred,
  round(stddev_pop(label), 6) as std_label from predictions group by run_id""",
    "V6_weighted_loss": with_views("predictions", extra=weighted_preds()) + f"""select run_id,
  round(sum(weight * ({smooth_l1()})) / count(*), 6) as train_loss from wp group by run_id""",
    "M3_score": head_score_sql(init_head(64, 64, 1, seed=0)),
    "V7_history": with_views("predictions", extra=weighted_preds() + ",\n" + HISTORY) + """select run_id, epoch,
  round(train_loss, 6) as train_loss, round(train_plcc, 6) as train_plcc, round(train_std_pred, 6) as train_std_pred,
  round(train_std_label, 6) as train_std_label, round(val_loss, 6) as val_loss, round(val_plcc, 6) as val_plcc,
  round(val_mae, 6) as val_mae, round(val_rmse, 6) as val_rmse, round(val_std_pred, 6) as val_std_pred,
  round(val_std_label, 6) as val_std_label, round(lr, 6) as lr from hist""",
    "V8_V9_best_stop_p1": best_stop(1),
    "V8_V9_best_stop_p2": best_stop(2),
    "E1_param_totals": with_views("manifest") + """select model, cast(sum(list_product(shape)) as bigint) as total_params,
  cast(coalesce(sum(case when trainable then list_product(shape) end), 0) as bigint) as trainable_params,
  cast(sum(list_product(shape)) - coalesce(sum(case when trainable then list_product(shape) end), 0) as bigint) as frozen_params
  from manifest group by model""",
    "E2_block_flops": f"""select doc_id, L, {block_flops('L')} as block_flops from
  ({DOC_LEN})""",
    "E3_image_flops": with_views("images") + "select origin, round(390000000.0 * (cast(height as double) * cast(width as double)) / 50176.0, 6) as image_flops from images",
    "E4_dataset_flops": f"""select lang, count(*) as docs, sum({model_flops('L', 'doc_id % 2 = 0')}) as total_flops from
  ({DOC_LEN}) group by lang""",
    "E5_resource_cost": with_views("models") + f"select model, round({resource_cost('params', 'flops')}, 6) as resource_cost from models",
    "E6_efficiency_factor": with_views("models") + f"select model, round({eff(resource_cost('params', 'flops'))}, 6) as efficiency_factor from models",
    "E7_ces": with_views("models") + f"select model, round(greatest(0.0, plcc) * {eff(resource_cost('params', 'flops'))}, 6) as ces from models",
    "E8_report": with_views("manifest", "predictions", extra=f"""t as (select model, cast(sum(list_product(shape)) as bigint) as total_params,
  cast(coalesce(sum(case when trainable then list_product(shape) end), 0) as bigint) as trainable_params from manifest group by model),
pc as (select 'Brand#' || cast(run_id + 1 as varchar) as model, case when isnan({pearson()}) then 0.0 else {pearson()} end as plcc
  from predictions group by run_id),
r as (select t.*, pc.plcc, {model_flops('128')} as flops from t left join pc using (model)),
r2 as (select *, {resource_cost('total_params', 'flops')} as c from r)""") + f"""select model, total_params, trainable_params,
  round(flops, 6) as flops, round(c, 6) as resource_cost, round({eff('c')}, 6) as efficiency_factor, round(plcc, 6) as plcc,
  round(case when plcc is not null then greatest(0.0, plcc) * {eff('c')} end, 6) as ces from r2""",
    "R1_warmup_drop": with_views("timings") + f"select run_id, batch_idx from timings where batch_idx >= {WARMUP}",
    "R2_cap": with_views("timings") + f"select run_id, batch_idx from timings where batch_idx >= {WARMUP} and batch_idx < {WARMUP + CAP}",
    "R3_R4_times": with_views("timings", extra=REPORT) + "select run_id, round(model_seconds, 6) as model_seconds, "
        "round(end_to_end_seconds, 6) as end_to_end_seconds from rep",
    "R5_rates": with_views("timings", extra=REPORT) + """select run_id, measured_batches, num_samples, num_input_tokens,
  round(end_to_end_seconds / num_samples * 1000.0, 6) as latency_ms_per_sample,
  round(num_samples / end_to_end_seconds, 6) as throughput_samples_per_sec,
  round(case when num_input_tokens > 0 then end_to_end_seconds / num_input_tokens * 1000.0 end, 6) as latency_ms_per_token,
  round(case when num_input_tokens > 0 then num_input_tokens / end_to_end_seconds end, 6) as throughput_tokens_per_sec,
  round(num_input_tokens / num_samples, 6) as avg_input_tokens_per_sample from rep""",
    "R5_rates_model_scope": with_views("timings", extra=REPORT) + """select run_id,
  round(model_seconds / num_samples * 1000.0, 6) as latency_ms_per_sample,
  round(num_samples / model_seconds, 6) as throughput_samples_per_sec from rep""",
    "R6_rejected_runs": with_views("timings", extra="""g as (select *, case when run_id % 10 = 3 then 0 else batch_size end as n from timings),
r as (select run_id, count(*) filter (batch_idx >= 70) as measured_batches, sum(n) filter (batch_idx >= 70) as num_samples,
  (max(end_us) filter (batch_idx >= 70) - min(start_us) filter (batch_idx >= 70)) / 1e6 as e2e, sum(tokens) filter (batch_idx >= 70) as tokens
  from g group by run_id),
x as (select *, case when measured_batches = 0 then 'no measured batch' when num_samples = 0 then 'no sample' end as reason from r)""") + """
select run_id, measured_batches, cast(coalesce(num_samples, 0) as bigint) as num_samples, reason from x where reason is not null""",
    "R6_checked_report": with_views("timings", extra="""g as (select *, case when run_id % 10 = 3 then 0 else batch_size end as n from timings),
r as (select run_id, count(*) filter (batch_idx >= 70) as measured_batches, sum(n) filter (batch_idx >= 70) as num_samples,
  (max(end_us) filter (batch_idx >= 70) - min(start_us) filter (batch_idx >= 70)) / 1e6 as e2e, sum(tokens) filter (batch_idx >= 70) as tokens
  from g group by run_id),
x as (select *, case when measured_batches = 0 then 'no measured batch' when num_samples = 0 then 'no sample' end as reason from r)""") + """
select run_id, measured_batches, cast(num_samples as bigint) as num_samples, reason, round(e2e, 6) as end_to_end_seconds,
  case when num_samples > 0 then round(e2e / num_samples * 1000, 6) end as latency_ms_per_sample,
  case when num_samples > 0 then round(tokens / num_samples, 6) end as avg_input_tokens_per_sample from x""",
    "R7_peak_memory": with_views("timings", extra=REPORT) + """select run_id, device, round(peak_alloc_mib, 6) as peak_alloc_mib,
  round(peak_reserved_mib, 6) as peak_reserved_mib from rep""",
}
