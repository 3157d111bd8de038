"""Common table expressions that the queries' SQL shares."""

from __future__ import annotations

import numpy as np

from ..operators.privacy import THRESHOLDS
from ..operators.split import dirichlet_proportions

#: Rows are samples of the first three classes where a model is scored, and of all ten where rows are dealt out.
MODEL_CLASSES, CLASSES, WIDTH, CLIENTS = 3, 10, 64, 4

PX = """px as materialized (
  select vec_id as id, label, cast(unnest(embedding) as double) as v, unnest(range(64)) as j from embeddings)"""
PX3 = PX + """, p3 as materialized (select * from px where label < 3),
params as materialized (select label as c, j, avg(v) * 8 as w from p3 group by all)"""
SCORED = PX3 + """,
logits as materialized (select id, label, c, sum(v * w) as z from p3 join params using (j) group by all),
top as (select *, max(z) over (partition by id) as mx from logits),
probs as materialized (select id, label, c, z, exp(z - mx) / sum(exp(z - mx)) over (partition by id) as p from top),
pred as materialized (
  select id, label, c as pred, confidence from (
    select *, max(p) over (partition by id) as confidence, row_number() over (partition by id order by round(z, 9) desc, c) as k from probs) where k = 1)"""


def hashed(seed: str, key: str = "id") -> str:
    return f"md5('{seed}:' || {key})"


def uniform(seed: str, key: str = "id") -> str:
    return f"(cast('0x' || substr({hashed(seed, key)}, 1, 8) as bigint) / 4294967296.0::double)"


def gauss(seed: str, key: str = "id") -> str:
    return f"(sqrt(-2.0::double * ln(1.0::double - {uniform(seed + 'a', key)})) * cos(2.0::double * pi() * {uniform(seed + 'b', key)}))"


def shares(alpha: float = 0.5, clients: int = CLIENTS) -> str:
    rows = dirichlet_proportions(CLASSES, clients, alpha)
    return ", ".join(f"({c}, [{', '.join(f'{x!r}::double' for x in row[:-1])}])" for c, row in enumerate(rows))


def dealt(alpha: float = 0.5, clients: int = CLIENTS, where: str = "true") -> str:
    return f"""ranked as (
  select vec_id as id, label, row_number() over (partition by label order by {hashed('42', 'vec_id')}) as rn, count(*) over (partition by label) as n
  from embeddings where {where}),
dealt as materialized (
  select id, ranked.label, cast(len(list_filter(s.cum, lambda x: ranked.rn > floor(x * ranked.n))) as int) as client
  from ranked join (values {shares(alpha, clients)}) s(label, cum) on s.label = ranked.label)"""


def thresholds() -> str:
    return "thresholds as (select unnest([" + ", ".join(f"{t!r}::double" for t in THRESHOLDS) + "]) as t)"


HISTORY = """history as (
  select cast(user_id % 50 as int) as step, round(avg(value) / 100, 6) as f1, count(*) as n from events group by all)"""


def rounds_sql(rounds: int, rate: float, where: str = "label < 3") -> str:
    """Federated rounds from zero parameters, one set of table expressions for each."""
    parts = [PX, dealt(where=where), f"""rows as materialized (select px.id, px.label, j, v, client from px join dealt using (id) where px.{where}),
sizes as (select client, count(*) / 64 as n from rows group by all),
w0 as (select c, j, 0.0::double as w from range(3) a(c), range(64) b(j))"""]  # fmt: skip
    for k in range(rounds):
        parts.append(f"""z{k} as materialized (select id, label, client, c, sum(v * w) as z from rows join w{k} using (j) group by all),
e{k} as materialized (select *, exp(z - max(z) over (partition by id)) as e from z{k}),
q{k} as materialized (select id, client, c, e / sum(e) over (partition by id) - case when c = label then 1.0::double else 0.0::double end as d from e{k}),
g{k} as materialized (select rows.client, c, j, sum(d * v) as g from rows join q{k} using (id) group by all),
u{k} as (select g{k}.client, c, j, w{k}.w - {rate!r}::double * g / n as w, n from g{k} join w{k} using (c, j) join sizes on sizes.client = g{k}.client),
w{k + 1} as materialized (select c, j, sum(w * n) / sum(n) as w from u{k} group by all)""")
    return ",\n".join(parts)


def steps_sql(rows: str, units: str, steps: int, rate: float, clip: float, width: int = WIDTH) -> str:
    """Full-batch steps from zero for units that each have a sigma; with noise, rows are clipped. `rows` selects (unit, id,
    label, j, v) and `units` (unit, client, sigma); the last weights are in s{steps}(unit, c, j, w)."""
    parts = [f"""urows as materialized ({rows}), unit as materialized ({units}), un as (select unit, count(*) / {width} as n from urows group by unit),
xn as materialized (select unit, id, sqrt(sum(v * v)) as x from urows group by all),
s0 as materialized (select unit, c, j, 0.0::double as w from unit, range(3) a(c), range({width}) b(j))"""]  # fmt: skip
    for k in range(steps):
        key = f"('{k}_' || client || '_' || c || '_' || j)"
        parts.append(f"""sz{k} as materialized (select unit, id, label, c, sum(v * w) as z from urows join s{k} using (unit, j) group by all),
se{k} as (select *, exp(z - max(z) over (partition by unit, id)) as e from sz{k}),
sd{k} as materialized (select unit, id, c, e / sum(e) over (partition by unit, id) - (c = label)::int as d from se{k}),
sc{k} as materialized (select unit, id, case when any_value(sigma) > 0 then least(1, {clip!r}::double / (sqrt(sum(d * d)) * any_value(x))) else 1.0::double end as s
  from sd{k} join xn using (unit, id) join unit using (unit) group by unit, id),
sg{k} as materialized (select unit, c, j, sum(d * s * v) as g from sd{k} join sc{k} using (unit, id) join urows using (unit, id) group by unit, c, j),
s{k + 1} as materialized (select unit, c, j, w - {rate!r}::double * (coalesce(g, 0) + case when sigma > 0 then {gauss('42', key)} * sigma * {clip!r}::double else 0 end) / n as w
  from s{k} join unit using (unit) join un using (unit) left join sg{k} using (unit, c, j))""")
    return ",\n".join(parts)


def batches_sql(rounds: int, steps: int, batch: int = 32, rate: float = 1e-2) -> str:
    """Rounds of one epoch of Adam in mini-batches on each client, `steps` of them at most; the last mean is in f{rounds}."""
    parts = [PX, dealt(where="label < 3"), """crows as materialized (select px.id, px.label, j, v, client from px join dealt using (id)), csize as (select client, count(*) / 64 as n from crows group by client),
f0 as materialized (select c, j, 0.0::double as w from range(3) a(c), range(64) b(j))"""]  # fmt: skip
    for r in range(rounds):
        parts.append(f"""o{r} as materialized (select id, (row_number() over (partition by client order by {hashed(f"batch_{r}_0")}) - 1) // {batch} as b from dealt),
r{r} as materialized (select crows.*, b from crows join o{r} using (id)),
m{r}_0 as materialized (select client, c, j, w, 0.0::double as m, 0.0::double as v from f{r}, csize)""")
        for k in range(steps):
            a = f"{r}_{k}"
            parts.append(f"""z{a} as materialized (select r.client, id, label, c, sum(r.v * w) as z from r{r} r join m{a} s on s.client = r.client and s.j = r.j where b = {k} group by all),
e{a} as (select *, exp(z - max(z) over (partition by id)) as e from z{a}),
d{a} as materialized (select client, id, c, e / sum(e) over (partition by id) - (c = label)::int as d from e{a}),
g{a} as materialized (select d.client, c, j, sum(d * v) / count(*) as g from d{a} d join r{r} r on r.id = d.id group by all),
n{a} as materialized (select s.*, g + 1e-4::double * w as g, 0.9::double * m + 0.1::double * (g + 1e-4::double * w) as m1, 0.999::double * v + 0.001::double * (g + 1e-4::double * w) * (g + 1e-4::double * w) as v1 from m{a} s left join g{a} using (client, c, j)),
m{r}_{k + 1} as materialized (select client, c, j, case when g is null then w else w - {rate!r}::double * (m1 / {1 - 0.9 ** (k + 1)!r}::double) / (sqrt(v1 / {1 - 0.999 ** (k + 1)!r}::double) + 1e-8::double) end as w, coalesce(m1, m) as m, coalesce(v1, v) as v from n{a})""")
        parts.append(f"f{r + 1} as materialized (select c, j, sum(w * n) / sum(n) as w from m{r}_{steps} join csize using (client) group by all)")
    return ",\n".join(parts)


def conv_sql(net) -> str:
    """Activations, probabilities and maps of a network of two layers, with a mean over 2 x 2 cells after the first, on 8 x 8 images."""
    values = lambda a: ", ".join("(" + ", ".join([*map(str, at), f"{float(v)!r}::double"]) + ")" for at, v in np.ndenumerate(a))
    k1, k2 = net.kernels
    return f"""{PX}, im as materialized (select id, j // 8 as y, j % 8 as x, v from px), k1 as (select * from (values {values(k1)}) t(f, ch, dy, dx, w)), k2 as (select * from (values {values(k2)}) t(f, ch, dy, dx, w)),
head as (select * from (values {values(net.head)}) t(c, f, w)),
a1 as materialized (select id, f as ch, im.y - dy + 1 as y, im.x - dx + 1 as x, greatest(0, sum(v * w)) as v from im, k1 where im.y - dy + 1 between 0 and 7 and im.x - dx + 1 between 0 and 7 group by all),
p1 as materialized (select id, ch, y // 2 as y, x // 2 as x, avg(v) as v from a1 group by all),
a2 as materialized (select id, f, p1.y - dy + 1 as y, p1.x - dx + 1 as x, greatest(0, sum(v * w)) as v from p1 join k2 using (ch) where p1.y - dy + 1 between 0 and 3 and p1.x - dx + 1 between 0 and 3 group by all),
mean as (select id, f, avg(v) as v from a2 group by all),
logit as materialized (select id, c, sum(v * w) as z from mean join head using (f) group by all),
prob as materialized (select id, c, z, exp(z - max(z) over (partition by id)) as e from logit),
best as materialized (select id, c, confidence from (select id, c, e / sum(e) over (partition by id) as confidence, row_number() over (partition by id order by round(z, 9) desc, c) as k from prob) where k = 1)"""


def cam_sql() -> str:
    """Maps of both layers of conv_sql(), for each image's predicted class."""
    return """w2 as (select id, f, w / 16 as w from best join head using (c)),
w1 as (select id, k2.ch, sum(w2.w * k2.w) / 64 as w from w2 join a2 using (id, f) join k2 using (f) where a2.v > 0 and a2.y + dy - 1 between 0 and 3 and a2.x + dx - 1 between 0 and 3 group by all),
c2 as materialized (select id, y, x, greatest(0, sum(w * v)) as v from a2 join w2 using (id, f) group by id, y, x),
heat as materialized (select id, 0 as layer, y * 8 + x as j, greatest(0, sum(coalesce(w, 0) * v)) as v from a1 left join w1 using (id, ch) group by id, y, x
  union all select id, 1, a.o * 8 + b.o, sum(a.w * b.w * v) from c2 join wt a on a.i = y join wt b on b.i = x group by id, a.o, b.o)"""


def experiment_sql(epochs: int, rate: float = 1e-2) -> str:
    """Central training by full-batch Adam with class weights, and the scores of train and test rows in esc(id, label, side, c, p, pred)."""
    parts = [f"""{PX}, lab as (select vec_id as id, label, row_number() over (order by {hashed('42', 'vec_id')}) as rn, count(*) over () as n from embeddings where label < 3),
side as materialized (select id, label, case when rn <= cast(floor(0.8::double * n) as bigint) then 'train' when rn <= cast(floor(0.9::double * n) as bigint) then 'val' else 'test' end as side from lab),
cw as materialized (select label, sum(count(*)) over () / (count(*) over () * count(*))::double as cw from lab group by label),
tr as materialized (select px.id, px.label, j, v, cw from px join side using (id) join cw on cw.label = px.label where side = 'train'), total as (select sum(cw) / 64 as t from tr),
t0 as materialized (select c, j, 0.0::double as w, 0.0::double as m, 0.0::double as v from range(3) a(c), range(64) b(j))"""]  # fmt: skip
    for k in range(epochs):
        parts.append(f"""tz{k} as (select id, tr.label, cw, c, sum(tr.v * w) as z from tr join t{k} using (j) group by all), te{k} as (select *, exp(z - max(z) over (partition by id)) as e from tz{k}),
td{k} as materialized (select id, c, cw * (e / sum(e) over (partition by id) - (c = label)::int) as d from te{k}),
tg{k} as materialized (select c, j, sum(d * v) / (select t from total) as g from td{k} join tr using (id) group by all),
tm{k} as (select t.c, t.j, w, 0.9::double * m + 0.1::double * (g + 1e-4::double * w) as m, 0.999::double * v + 0.001::double * (g + 1e-4::double * w) * (g + 1e-4::double * w) as v from t{k} t join tg{k} using (c, j)),
t{k + 1} as materialized (select c, j, w - {rate!r}::double * (m / {1 - 0.9 ** (k + 1)!r}::double) / (sqrt(v / {1 - 0.999 ** (k + 1)!r}::double) + 1e-8::double) as w, m, v from tm{k})""")
    parts.append(f"""ez as materialized (select px.id, px.label, side, c, sum(px.v * w) as z from px join side using (id) join t{epochs} using (j) where side <> 'val' group by all),
ee as (select *, exp(z - max(z) over (partition by id)) as e, row_number() over (partition by id order by round(z, 9) desc, c) as k from ez),
esc as materialized (select id, label, side, c, e / sum(e) over (partition by id) as p, max(case when k = 1 then c end) over (partition by id) as pred from ee)""")
    return ",\n".join(parts)


def conv_gradient_sql() -> str:
    """The cross-entropy's gradient by all weights of conv_sql()'s network, over rows of the first three classes: (part, i, g)."""
    return """lab as (select vec_id as id, label from embeddings where label < 3),
dz as materialized (select id, c, p - (c = label)::int as d from (select id, c, e / sum(e) over (partition by id) as p from prob) join lab using (id)),
df as (select id, f, sum(d * w) / 16 as g from dz join head using (c) group by id, f),
d2 as materialized (select id, f, y, x, g from a2 join df using (id, f) where v > 0),
g2 as (select f, p1.ch, dy, dx, sum(g * v) as g from d2, range(3) r(dy), range(3) s(dx), p1 where p1.id = d2.id and p1.y = d2.y + dy - 1 and p1.x = d2.x + dx - 1 group by all),
dp as materialized (select id, ch, d2.y + dy - 1 as y, d2.x + dx - 1 as x, sum(g * w) as g from d2 join k2 using (f) group by all),
d1 as materialized (select a1.id, a1.ch as f, a1.y, a1.x, g / 4 as g from a1 join dp on dp.id = a1.id and dp.ch = a1.ch and dp.y = a1.y // 2 and dp.x = a1.x // 2 where a1.v > 0),
g1 as (select f, dy, dx, sum(g * v) as g from d1, range(3) r(dy), range(3) s(dx), im where im.id = d1.id and im.y = d1.y + dy - 1 and im.x = d1.x + dx - 1 group by all),
grad as (select 'kernel_0' as part, (f * 9 + dy * 3 + dx) as i, coalesce(g, 0) as g from k1 left join g1 using (f, dy, dx)
  union all select 'kernel_1', ((f * 2 + ch) * 9 + dy * 3 + dx), coalesce(g, 0) from k2 left join g2 using (f, ch, dy, dx)
  union all select 'bias_0', k.f, coalesce(sum(g), 0) from (select distinct f from k1) k left join d1 using (f) group by k.f
  union all select 'bias_1', k.f, coalesce(sum(g), 0) from (select distinct f from k2) k left join d2 using (f) group by k.f
  union all select 'head', c * 3 + f, sum(d * v) from dz join mean using (id) group by c, f union all select 'bias', c, sum(d) from dz group by c)"""
