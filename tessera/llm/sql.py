"""SQL that gives the same rows as a query of this subpackage, where SQL can."""

_FOLD = "lower(trim({}, ' ' || chr(9) || chr(160)))"

_WORDED = r"regexp_matches(text, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')"

_P4_TERMS = f"""
with rows_ as (
  select 'frame_label' as field_name, {_FOLD.format("frame_label")} as term, global_id from frameinstances
  union all
  select 'lu_lemma', {_FOLD.format("lu_lemma")}, global_id from frameinstances
), counted as (
  select field_name, term, count(*) as occurrences, count(distinct global_id) as records
  from rows_ where term is not null and term not in ('', '<unk>') group by field_name, term
), marked as (
  select *, case when records <= 2 then 'rare'
    when records > 0.05 * (select count(distinct global_id) from frameinstances) then 'common' end as mark from counted
)"""

_VECTORS = """
    v as (
      select key, min(cast(embedding as double[])) as e from instance_vectors
      where masking = 'unmasked' and len(embedding) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by key
    ),
    n as (select key, e, sqrt(list_dot_product(e, e)) as l from v)"""

# sentences as bags of tokens first: those that differ in more than a fifth of them can't be within the allowed edits; of the others the
# matrix of edit distances is filled cell by cell
_P5 = rf"""
    with recursive raw as (
      select {_FOLD.format("global_sentence_id")} as id, tokenized_sentence as t, {_FOLD.format("data_source")} as source, instance_id from salsa where global_sentence_id is not null
    ), splits_ as (
      select instance_id, max({_FOLD.format("split")}) as split from split_instances where datasetsplit_id = 1 group by instance_id
    ), sentence as (
      select r.id, max(t) as t, max(s.split) as split from raw r left join splits_ s using (instance_id) group by r.id having max(s.split) in ('train', 'dev', 'test')
    ), toks as (
      select id, split, list_filter(regexp_split_to_array(replace(replace(replace(replace(lower(coalesce(t, '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) as w from sentence
    ), long as (select id, split, w, len(w) as n from toks where len(w) >= 8),
    texts as (select w, any_value(n) as n, row_number() over (order by w) as x, bool_or(split = 'train') as a, bool_or(split <> 'train') as b from long group by w),
    bag as (
      select x, a, b, n, word, row_number() over (partition by x, word) as nth from (select x, a, b, n, unnest(w) as word from texts)
    ), shared as (
      select p.x as x, q.x as y, any_value(greatest(p.n, q.n)) as m, count(*) as c from bag p join bag q on p.word = q.word and p.nth = q.nth
      where p.a and q.b and p.x <> q.x and abs(p.n - q.n) * 5 <= greatest(p.n, q.n) group by p.x, q.x
    ), close as (
      select s.x, s.y, p.w as v, q.w as w, m from shared s join texts p on p.x = s.x join texts q on q.x = s.y where (m - c) * 5 <= m
    ), cells as (
      select x, y, v, w, m, 1 as i, 1 as j, range(0, len(w) + 1) as above, [cast(1 as bigint)] as line from close
      union all
      select x, y, v, w, m, case when j = len(w) then i + 1 else i end, case when j = len(w) then 1 else j + 1 end,
        case when j = len(w) then line || [least(above[j + 1] + 1, line[j] + 1, above[j] + case when v[i] = w[j] then 0 else 1 end)] else above end,
        case when j = len(w) then [cast(i + 1 as bigint)] else line || [least(above[j + 1] + 1, line[j] + 1, above[j] + case when v[i] = w[j] then 0 else 1 end)] end
      from cells where i <= len(v)
    ), linked as (
      select x, y from cells where i > len(v) and above[len(w) + 1] * 5 <= m union all select x, x from texts where a and b
    ), pairs as (
      select p.id as train_id, q.id as other_id, l.x = l.y as exact from linked l join texts t on t.x = l.x join texts u on u.x = l.y
      join long p on p.w = t.w and p.split = 'train' join long q on q.w = u.w and q.split <> 'train'
    )"""

SQL: dict[str, str] = {
    "p5_found": _P5 + " select distinct least(train_id, other_id) as sentence_a, greatest(train_id, other_id) as sentence_b from pairs",
    "p5_report": _P5 + """, named as (select distinct id, source from raw where source is not null), found as (select other_id as id, bool_or(exact) as exact from pairs group by 1)
        select split, source, count(*) as n_records, count(exact) as n_overlapping, count(*) filter (exact) as n_exact
        from long left join named using (id) left join found using (id) where split <> 'train' group by split, source""",
    # a set in which all belong together and none to a key outside: all members have the same neighbours, themselves included
    "p1_found": f"""
        with {_VECTORS},
        r as (select n.*, {_FOLD.format("lu_lemma")} as g from n join frameinstances f on f.id = n.key where lu_lemma is not null),
        pairs as (select a.key as a, b.key as b from r a join r b on a.g = b.g and a.key <> b.key where list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
        near as (select a, list_sort(list(b) || [a]) as own from pairs group by a),
        bad as (select distinct p.a from pairs p join near x on x.a = p.a join near y on y.a = p.b where x.own <> y.own)
        select own[1] as cluster_key, a as instance_key from near where a not in (select a from bad)""",
    "p3_found": f"""
        with {_VECTORS},
        pairs as (select a.key as a, b.key as b, round(list_dot_product(a.e, b.e) / (a.l * b.l), 9) as c from n a join n b on a.key <> b.key where list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.89),
        best as (select * from pairs qualify row_number() over (partition by a order by c desc, b) <= 5)
        select distinct least(a, b) as key_a, greatest(a, b) as key_b from best where c >= 0.9""",
    "p3_neighbours": f"""
        with {_VECTORS},
        pairs as (select a.key, b.key as neighbour, round(list_dot_product(a.e, b.e) / (a.l * b.l), 9) as similarity from n a join n b on a.key <> b.key where a.key % 20 = 0)
        select key, neighbour, round(similarity, 6) as similarity, row_number() over (partition by key order by pairs.similarity desc, neighbour) as rank from pairs
        qualify row_number() over (partition by key order by pairs.similarity desc, neighbour) <= 5""",
    "p2_found": """
        with latest as (
          select *, row_number() over (partition by experiment_run_id order by reported_at desc) as v from experiment_scores
        ), ranked as (
          select experiment_id, experiment_run_id,
            row_number() over (partition by experiment_id order by micro_f1__novelty_frame desc, experiment_run_id) as n
          from latest
          where v = 1 and experiment_id is not null and micro_f1__novelty_frame is not null and not isnan(micro_f1__novelty_frame)
        )
        select experiment_id, experiment_run_id from ranked where n <= 5""",
    "p4_terms": _P4_TERMS + " select field_name, term, occurrences, records, mark from marked",
    "p4_found": _P4_TERMS + " select field_name, term, mark from marked where mark is not null",
    "p8_kept": rf"""
        select count(*) as n_texts, cast(0 as bigint) as divided, cast(0 as bigint) as changed, cast(0 as bigint) as too_full, true as filled from documents
        where doc_id is not null and {_WORDED}""",
    "p9_kept": rf"""
        select count(distinct source) as n_sources, cast(0 as bigint) as beyond_cap, cast(0 as bigint) as of_no_target, true as on_target
        from documents where doc_id is not null and {_WORDED} and source in (select source from source_targets where target_share > 0 and max_repeats > 0)""",
    # how rows are assigned is open; what must hold of any assignment is not
    "p6_kept": f"""
        select count(*) as n_rows, count(distinct {_FOLD.format("global_sentence_id")}) as n_sentences, cast(0 as bigint) as divided_sentences, cast(0 as bigint) as divided_texts, true as on_target
        from salsa where global_sentence_id is not null""",
    "p6_found": f"""
        select {_FOLD.format("global_sentence_id")} as global_sentence_id from salsa
        where global_sentence_id is not null group by 1 having count(distinct {_FOLD.format("split")}) >= 2""",
}
