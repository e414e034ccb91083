"""SQL that gives the same rows as the queries of this package, over whole tables."""

_SHINGLES = r"""
w as (select article_no as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from articles),
s as (
  select distinct id, hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) as h
  from (select id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 30)
), n as (select id, count(*) as n from s group by id),
j as (
  select x.id as a, y.id as b, count(*) as c from s x join s y on x.h = y.h and x.id < y.id group by all
)
"""

_LINKS = "l as (select a, b from j join n p on p.id = a join n q on q.id = b where c >= {t} * (p.n + q.n - c))"

_GROUPS = """
e as (select a as u, b as v from l union all select b, a from l),
r as (select u as node, u as root from e union select e.v, r.root from r join e on e.u = r.node),
g as (select node, min(root) as g from r group by node)
"""

_OVERLAP = r"""
p as (
  select article_no as id, dataset, split, lower(trim(outlet)) as outlet, split = 'train' as train,
         nullif(regexp_replace(regexp_replace(trim(id), '\.0$', ''), '^0+(.)', '\1'), '') as own,
         regexp_extract_all(lower(title), '[a-z0-9]+') as tw,
         coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) < 30 as short
  from articles where split in ('train', 'val', 'test', 'heldout')
), o as (
  select t.id as t, e.id as e, 'text' as reason from l join p t on t.id in (a, b) and t.train join p e on e.id in (a, b) and not e.train
  union all
  select t.id, e.id, 'id' from p t join p e on t.train and not e.train and t.dataset = e.dataset and t.own = e.own
  union all
  select t.id, e.id, 'title' from p t join p e on t.train and not e.train and t.tw = e.tw and len(t.tw) >= 5 and (t.short or e.short)
)
"""

_KEYS = r"""
k as (
  select link_id, coalesce('q:' || nullif(regexp_replace(upper(trim(qid, e' \t\r\n')), '^WD:', ''), ''),
                           'm:' || nullif(lower(trim(regexp_replace(mention, '[ \t\r\n]+', ' ', 'g'))), '')) as key
  from linked_entities
  union all select -1, 'q:' || nullif(regexp_replace(upper(trim(record.qid, e' \t\r\n')), '^WD:', ''), '') from kb_search
  union all select -1, 'm:' || nullif(lower(trim(regexp_replace(mention, '[ \t\r\n]+', ' ', 'g'))), '') from kb_search
), f as (select key, min(link_id) as first from k where key is not null group by key)
"""

_TERMS = r"""
x as (select article_no, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from articles),
y as (select term, count(*) as n_occurrences, count(distinct article_no) as n_records from x group by term),
z as (select y.*, case when n_records < 2 then 'rare' when n_records > 0.8 * (select count(distinct article_no) from x) then 'common' end as mark from y)
"""

_FREQUENT = r"""
i as (
  select 'qid' as field, nullif(regexp_replace(upper(trim(qid, e' \t\r\n')), '^WD:', ''), '') as item from linked_entities
  union all select 'mention', lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) from mentions
), c as (select field, item, count(*) as n from i where item is not null group by all),
q as (select field, item from c qualify n >= 0.008 * sum(n) over (partition by field))
"""

_LINKED = f"""with recursive {_SHINGLES.replace('>= 30', '>= 5')}, c as (select id, min(id) over (partition by w) as rep from w where len(w) >= 5),
      l as (select j.a, j.b from j join n p on p.id = j.a join n q on q.id = j.b join c x on x.id = a and x.rep = a join c y on y.id = b and y.rep = b where j.c >= 0.8 * (p.n + q.n - j.c)), {_GROUPS}"""

ORACLE = {
    "p1_found": f"with recursive {_SHINGLES}, {_LINKS.format(t=0.6)}, {_GROUPS} select x.node as article_no_a, y.node as article_no_b from g x join g y on x.g = y.g and x.node < y.node",
    "p1_groups": f"{_LINKED} select c.id as article_no, c.rep, coalesce(g.g, c.rep) as group_no from c left join g on g.node = c.rep",
    "p1_links": f"""{_LINKED}, k as (select rep, count(*) as n from (select a as rep from l union all select b from l) group by rep)
      select c.id as article_no, c.rep, coalesce(g.g, c.rep) as group_no, coalesce(k.n, 0) as n_links from c left join g on g.node = c.rep left join k on k.rep = c.rep""",
    "p4_found": f"with {_SHINGLES}, {_LINKS.format(t=0.6)}, {_OVERLAP} select distinct least(t, e) as article_no_a, greatest(t, e) as article_no_b from o",
    "p4_report": f"""with {_SHINGLES}, {_LINKS.format(t=0.6)}, {_OVERLAP},
      h as (select e, reason, count(*) as pairs from o group by all),
      m as (select split, outlet, count(*) as n_rows from p where not train group by all)
      select reason, p.split, p.outlet, any_value(n_rows) as n_rows, count(*) as n_hit, sum(pairs)::bigint as n_pairs
      from h join p on p.id = h.e join m on m.split = p.split and m.outlet is not distinct from p.outlet group by all""",
    "p3_found": f"with {_KEYS} select link_id from k join f using (key) where first < link_id",
    "p3_audit": f"""with {_KEYS}, r as (select link_id, first < link_id as seen from k join f using (key) where link_id >= 0)
      select count(*) as n_rows, (select count(*) from f) as n_keys, 0.0::double as expected_false_positives, 0 as false_positives, 0 as false_negatives, 0 as unanswered,
        count(*) filter (not seen) as n_new, 0.0::double as false_positive_rate from r""",
    "p6_counts": f"""with {_FREQUENT}, t as (select field, sum(n) as rows from c group by field)
      select field, item, n::bigint as n, round(n / rows, 9) as share from q join c using (field, item) join t using (field)""",
    "p6_found": f"with {_FREQUENT} select field, item from q",
    "p7_found": f"with {_TERMS} select term, mark from z where mark is not null",
    "p9_checks": """select lower(trim(source_name)) as source, target_share, max_repeats, true as within_repeats, true as epochs_whole, true as within_budget, true as filled, true as short_at_cap
      from mix_targets where source_name is not null and target_share > 0 and max_repeats > 0""",
    "p7_terms": f"with {_TERMS} select * from z",
}
