"""The same queries as SQL over the same tables."""

from __future__ import annotations

_FOLD = "lower(trim({}, ' ' || chr(9) || chr(160)))"
_LEMMA, _LABEL = _FOLD.format("lu_lemma"), f"case when {_FOLD.format('frame_label')} not in ('', '<unk>') then {_FOLD.format('frame_label')} end"

# instances and bridge rows in one spelling: blanks are cut by pattern here
_CUT = "regexp_replace(lower({}), '^[ \\t\u00a0]+|[ \\t\u00a0]+$', '', 'g')"
_I = f"(select id, dataset_id, nullif({_CUT.format('lu_lemma')}, '') as lu_lemma, nullif({_CUT.format('frame_label')}, '') as frame_label, global_id, extrainfo from frameinstances)"
_S = f"(select distinct datasetsplit_id, instance_id, {_CUT.format('split')} as split from split_instances)"

_P7 = f"""
    with results as (
      select {_LEMMA} as lu_lemma, count(*) as n_rows, count(distinct {_LABEL}) as n_labels, count(distinct global_id) as n_instances,
        count(*) > 0.025 * (select count(*) from frameinstances) as is_large
      from frameinstances where lu_lemma is not null group by 1
    )"""

_BASE = f"""
    splits_ as (select * from {_S}),
    train as (
      select s.instance_id, s.split, f.lu_lemma, f.frame_label from splits_ s join {_I} f on f.id = s.instance_id
      where datasetsplit_id = 1 and split in ('train', 'dev')
    ),
    clusters_ as (
      select lu_lemma || '::' || frame_label as id, frame_label as transitive_label, frame_label <> '<unk>' as isknown, count(*) as numelems
      from {_I} where lu_lemma is not null and frame_label is not null group by 1, 2, 3
    ),
    assignments_ as (
      select id as instanceid, lu_lemma || '::' || frame_label as clusterid, lu_lemma as local_cluster_id
      from {_I} where lu_lemma is not null and frame_label is not null
    ),
    evaluation_ as (
      select f.id as instanceid, s.split, f.frame_label as label_true, f.lu_lemma, c.id as cid, c.id as clabel, c.transitive_label
      from splits_ s join {_I} f on f.id = s.instance_id
      left join assignments_ a on a.instanceid = f.id left join clusters_ c on c.id = a.clusterid
      where s.datasetsplit_id = 1 and s.split in ('test')
    )"""


def _base(sql: str) -> str:
    return f"with {_BASE} {sql}"


_CLUSTERINGS = """
    top as (
      select clustering_id as id, micro_f1__novelty_frame as micro_f1, clusterer, datasetsplit, splits, numclusters, clustering_duration, local_cid, local_clusterer, numclusters_local
      from experiment_scores where clustering_id is not null
      qualify row_number() over (partition by clustering_id order by reported_at desc, micro_f1__novelty_frame desc nulls last, experiment_run_id desc) = 1
    ),
    clusterings_ as (
      select id, 'localglobal' as type, micro_f1, clusterer, datasetsplit, [splits[len(splits)]] as testsplits, numclusters, clustering_duration as duration, local_cid as clusteringid_local
      from top
      union all
      select local_cid, 'local', null, min(local_clusterer), arg_min(datasetsplit, d.id), null, min(numclusters_local), null, null
      from top left join datasetsplits d on d.name = datasetsplit where local_cid is not null group by local_cid
    ),
    scored as (
      select c.id as cid, c.micro_f1 as micro_f1__novelty_frame, coalesce(c.clusterer, l.clusterer) as clusterer, c.type, l.clusterer as local_clusterer,
        (select d.name from datasetsplits d where d.name = c.datasetsplit) as datasetsplit, c.testsplits, c.numclusters, l.numclusters as numclusters_local, c.duration, l.id as local_cid
      from clusterings_ c left join clusterings_ l on l.id = c.clusteringid_local and l.type = 'local'
    )"""

_PREDICTED = f"""
    rows_ as (
      select s.instance_id, s.split, f.lu_lemma, f.frame_label from {_S} s join {_I} f on f.id = s.instance_id
      where datasetsplit_id = 1 and split in ('train', 'dev', 'test') and frame_label <> '<unk>' and lu_lemma is not null
    ),
    top as (
      select lu_lemma, frame_label as predicted from rows_ where split = 'train' group by lu_lemma, frame_label
      qualify row_number() over (partition by lu_lemma order by count(*) desc, frame_label) = 1
    ),
    p as (
      select r.frame_label as gold, coalesce(t.predicted, 'new::' || r.lu_lemma) as predicted
      from rows_ r left join top t using (lu_lemma) where r.split <> 'train'
    ),
    known as (
      select distinct frame_label as label from {_S} s join {_I} f on f.id = s.instance_id
      where datasetsplit_id = 1 and split = 'train' and frame_label <> '<unk>'
    )"""


def _report(pairs: str, labels: str, order: str = "", averages: bool = False) -> str:
    """Report over the relation ``pairs`` (gold, predicted) for the relation ``labels`` (label)."""
    per = f"""
    counted as (
      select label, (select count(*) from {pairs} where gold = label and predicted = label) as tp,
        (select count(*) from {pairs} where predicted = label) as np, (select count(*) from {pairs} where gold = label) as ng
      from {labels}
    ),
    scored_ as (
      select *, case when np = 0 then 0.0 else tp / np end as pr, case when ng = 0 then 0.0 else tp / ng end as re from counted
    ),
    report as (select label, tp, np, pr, re, case when pr + re = 0 then 0.0 else 2 * pr * re / (pr + re) end as f, ng from scored_)"""
    if not averages:
        return per + f" select label, round(pr, 9) as precision, round(re, 9) as recall, round(f, 9) as f1, ng as support from report {order}"
    micro = "sum(tp) / sum(np), sum(tp) / sum(ng)"
    return per + f"""
    select 'micro' as average, round(a, 9) as precision, round(b, 9) as recall, round(case when a + b = 0 then 0 else 2 * a * b / (a + b) end, 9) as f1, support
    from (select {micro}, cast(sum(ng) as bigint) from report) as m(a, b, support)
    union all select 'macro', round(avg(pr), 9), round(avg(re), 9), round(avg(f), 9), cast(sum(ng) as bigint) from report
    union all select 'weighted', round(sum(pr * ng) / sum(ng), 9), round(sum(re * ng) / sum(ng), 9), round(sum(f * ng) / sum(ng), 9), cast(sum(ng) as bigint) from report"""


def _induction(source: str) -> str:
    return f"""
    t as (select gold, predicted, count(*) as n from {source} group by 1, 2),
    c as (select predicted, sum(n) as s, max(n) as m from t group by 1),
    g as (select gold, sum(n) as s, max(n) as m from t group by 1),
    v as (
      select (select sum(m) from c) / (select sum(n) from t) as pu, (select sum(m) from g) / (select sum(n) from t) as ip,
        (select sum(n * n / c.s) from t join c using (predicted)) / (select sum(n) from t) as bp,
        (select sum(n * n / g.s) from t join g using (gold)) / (select sum(n) from t) as br,
        (select sum(n * (n - 1) / 2) from t) / sqrt((select sum(s * (s - 1) / 2) from c) * (select sum(s * (s - 1) / 2) from g)) as fmi
    )
    select round(pu, 9) as purity, round(ip, 9) as inverse_purity, round(2 * pu * ip / (pu + ip), 9) as purity_f1, round(bp, 9) as bcubed_precision,
      round(br, 9) as bcubed_recall, round(2 * bp * br / (bp + br), 9) as bcubed_f1, round(coalesce(fmi, 0), 9) as fmi from v"""


_VECTORS = """
    u as (
      select key, min(cast(embedding as double[])) as e from instance_vectors
      where masking = 'unmasked' and len(embedding) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by key
    ),
    m as (
      select key, min(cast(embedding as double[])) as e from instance_vectors
      where masking = 'masked' and len(embedding) = 64 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by key
    )"""


def _norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


_CENTROIDS = """
    means as (
      select label, i - 1 as i, avg(cast(embedding[i] as double)) as x, count(*) as n from embeddings, generate_series(1, 64) as s(i) group by label, i
    ),
    centres as (select label, any_value(n) as n, list(x order by i) as c from means group by label),
    unit as (select label, n, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) as c from centres)"""


def _fingerprints(name: str, rows: str, columns: list[str]) -> str:
    """Fingerprints of the groups ``grp`` of a relation, over some columns."""
    parts = ", ".join(f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), 'null')" for c in columns)
    words = ", ".join(f"cast(sum(cast(cast('0x' || substr(d, {8 * i + 1}, 8) as ubigint) as hugeint)) as varchar) as w{i}" for i in range(4))
    return f"""
        select grp as {name}, n, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) as fingerprint
        from (select grp, n, md5(concat_ws(',', n, w0, w1, w2, w3)) as h from (select grp, count(*) as n, {words} from (select grp, md5(concat_ws('|', {parts})) as d from ({rows})) group by grp))"""


_IMPORTED = "(select min(id) as id, global_id from frameinstances where global_id is not null group by global_id)"
_SALSA = f"select * replace ({_CUT.format('split')} as split) from salsa where not coalesce(ends_with(frame_id, '-salsa'), false)"

SQL: dict[str, str] = {
    "p7_found": _P7 + " select lu_lemma from results where is_large",
    "p7_lemma_results": _P7 + " select lu_lemma, n_rows, n_labels, n_instances, is_large from results",
    "p7_label_agreement": f"""
        with known as (
          select {_LEMMA} as lu_lemma, {_LABEL} as label from frameinstances where lu_lemma is not null and {_LABEL} is not null
        ), counts as (
          select lu_lemma, label, count(*) as c, row_number() over (partition by lu_lemma order by count(*) desc, label) as n
          from known group by lu_lemma, label
        )
        select lu_lemma, max(case when n = 1 then label end) as top_label, max(c) as n_agree, cast(sum(c) as bigint) as n_labelled
        from counts group by lu_lemma""",
    "instances_in_splits": f"""
        select f.dataset_id, d.name as dataset_name, s.datasetsplit_id, n.name as datasetsplit_name, s.split, s.instance_id, f.lu_lemma, f.frame_label, f.global_id
        from {_S} s join {_I} f on s.instance_id = f.id
        join datasetsplits n on s.datasetsplit_id = n.id join datasets d on f.dataset_id = d.id""",
    "labels_of_dataset": f"select frame_label as label, count(*) as numinstances, min(id) as first_instance, max(id) as last_instance from {_I} where dataset_id = 1 group by frame_label",
    "labels_of_splits": _base("select frame_label as label, count(frame_label) as support, min(instance_id) as first_instance, max(instance_id) as last_instance from train group by frame_label"),
    "known_labels": _base("select frame_label as label, count(frame_label) as support from train group by frame_label"),
    "lemma_groups": _base("select lu_lemma, count(*) as numel from train group by lu_lemma having count(*) >= 5"),
    "filtered_lemmas": _base("select lu_lemma, cast(sum(n) as bigint) as numel_filtered from (select lu_lemma, split, count(*) as n from train group by 1, 2 having split <> any(['dev']) or count(*) between 3 and 100) group by lu_lemma"),
    "filtered_lemmas_two_tests": _base("select lu_lemma, cast(sum(n) as bigint) as numel_filtered from (select lu_lemma, split, count(*) as n from train group by 1, 2 having split <> any(['dev', 'test']) or count(*) between 3 and 100) group by lu_lemma"),
    "cluster_sizes": _base("""
        select 1 as clusteringid, clusterid, clusterid as label_unique, any_value(transitive_label) as label_transitive, any_value(numelems) as numel_clustered,
          count(distinct local_cluster_id) as numel_localclusters, count(distinct instanceid) as numel_instances
        from assignments_ a join clusters_ c on c.id = a.clusterid group by clusterid"""),
    "cluster_sizes_by_transitive_label": _base("""
        select 1 as clusteringid, transitive_label as label_transitive, count(*) as num_unique_clusters, cast(sum(ni) as bigint) as numel_instances, cast(sum(nl) as bigint) as numel_localclusters
        from (select clusterid, any_value(transitive_label) as transitive_label, count(distinct instanceid) as ni, count(distinct local_cluster_id) as nl
          from assignments_ a join clusters_ c on c.id = a.clusterid group by clusterid) group by transitive_label"""),
    "merged_clusters": _base("select 1 as clusteringid, transitive_label, bool_or(isknown) as isknown, cast(sum(numelems) as bigint) as numelems, count(*) as n_parts from clusters_ group by transitive_label"),
    "usable_clusters": _base("select id as label, isknown, numelems from clusters_ where isknown or numelems between 2 and 10"),
    "instance_assignments": _base(f"""
        select s.instance_id, d.name as dataset_name, n.name as datasetsplit_name, s.split, c.id as clusterlabel, c.transitive_label as tclusterlabel, 'localglobal' as clusteringtype, f.global_id
        from splits_ s join {_I} f on s.instance_id = f.id join datasetsplits n on n.id = s.datasetsplit_id join datasets d on d.id = f.dataset_id
        join assignments_ a on a.instanceid = f.id join clusters_ c on c.id = a.clusterid where s.datasetsplit_id = 1"""),
    "evaluation_table": _base("select * from evaluation_"),
    "unassigned_instances": _base("select count(*) as n from evaluation_ where cid is null"),
    "delete_clustering": f"""
        select '2::' || frame_label as id, 2 as clusteringid, frame_label as label, count(*) as numelems, count(id) as n_assignments
        from {_I} where frame_label is not null group by frame_label""",
    "scored_clusterings": f"with {_CLUSTERINGS} select cid, micro_f1__novelty_frame, clusterer, type, local_clusterer, datasetsplit, numclusters, numclusters_local, duration, local_cid from scored",
    "scores_for_test_splits": f"with {_CLUSTERINGS} select cid, micro_f1__novelty_frame from scored where datasetsplit = 'salsa2.0-default' and list_has_all(testsplits, ['test']) and list_has_all(['test'], testsplits)",
    "experiment_scores_view": f"""with {_CLUSTERINGS}
        select r.experiment_id, n.name, r.experiment_run_id, r.status, r.clustering_id, s.micro_f1__novelty_frame, s.clusterer, s.numclusters_local
        from (select distinct experiment_id, experiment_run_id, clustering_id, status from experiment_scores where experiment_id is not null) r
        join (select experiment_id, min(name) as name from experiment_scores group by 1) n using (experiment_id) join scored s on s.cid = r.clustering_id""",
    "sentence_matches": "select id, global_id from frameinstances where dataset_id = 2 and array_to_string(list_transform(extrainfo.tokens, lambda t: coalesce(lower(t), '*')), ' ') like '%director%the%near%'",
    "differs_from_any": f"""
        select split, count(*) filter (split <> any(['test'])) as n_one, count(*) filter (split <> any(['test', 'dev'])) as n_two, count(*) filter (split = any(['test', 'dev'])) as n_any
        from {_S} group by split""",
    "lockstep_unnest": """
        select id, count(*) as n, count(token) as n_tokens, count(target) as n_targets
        from (select id, unnest(extrainfo.tokens) as token, unnest(extrainfo.lu_index) as target from frameinstances where extrainfo.tokens is not null) group by id""",
    "classification_report": f"with {_PREDICTED}, labels_ as (select gold as label from p union select predicted from p), {_report('p', 'labels_')}",
    "classification_averages": f"with {_PREDICTED}, labels_ as (select gold as label from p union select predicted from p), {_report('p', 'labels_', averages=True)}",
    "novelty_detection": f"""with {_PREDICTED}, q as (
          select case when gold in (select label from known) then 'known' else 'novel' end as gold, case when predicted in (select label from known) then 'known' else 'novel' end as predicted from p
        ), labels_ as (select gold as label from q union select predicted from q), {_report('q', 'labels_')}""",
    "known_label_identification": f"with {_PREDICTED}, q as (select * from p where gold in (select label from known)), labels_ as (select distinct gold as label from q), {_report('q', 'labels_')}",
    "novelty_and_label_identification": f"""with {_PREDICTED}, q as (
          select case when gold in (select label from known) then gold else 'outlier' end as gold, case when predicted in (select label from known) then predicted else 'outlier' end as predicted from p
        ), labels_ as (select label from known union all select 'outlier'), {_report('q', 'labels_')}""",
    "majority_fallback": f"""with {_PREDICTED}, best as (
          select predicted from p where predicted in (select label from known) group by predicted order by count(*) desc, predicted limit 1
        )
        select case when predicted in (select label from known) then predicted else (select predicted from best) end as predicted, count(*) as n from p group by 1""",
    "induction_scores": f"with {_PREDICTED}, {_induction('p')}",
    "unknown_induction_scores": f"with {_PREDICTED}, q as (select * from p where gold not in (select label from known)), {_induction('q')}",
    "label_set_sizes": f"""with {_PREDICTED}, g as (select distinct gold as label from p), q as (select distinct predicted as label from p)
        select (select count(*) from g) as n_gold, (select count(*) from q) as n_predicted, (select count(*) from known) as n_known,
          (select count(*) from (select * from g union select * from q)) as n_any, (select count(*) from (select * from g intersect select * from q)) as n_both,
          (select count(*) from (select * from g except select * from q)) as n_gold_only, (select count(*) from (select * from q except select * from g)) as n_predicted_only,
          (select count(*) from (select * from g intersect select * from known)) as n_gold_known, (select count(*) from (select * from g except select * from known)) as n_gold_new,
          (select count(*) from (select * from q intersect select * from known)) as n_predicted_known""",
    "mixed_vectors": f"""with {_VECTORS}, w as (
          select key, list_transform(list_zip(u.e, m.e), lambda z: 0.3 * z[1] + (1 - 0.3) * z[2]) as v from u join m using (key)
        ), x as (select key, generate_subscripts(v, 1) - 1 as i, unnest(list_transform(v, lambda y: y / {_norm('v')})) as x from w)
        select key, i, round(x, 6) as x from x""",
    "blended_vectors": f"""with {_VECTORS}, w as (
          select key, list_transform(list_zip(u.e, m.e), lambda z: (1 - 0.3) * z[1] + 0.3 * z[2]) as v from u join m using (key)
        )
        select key, len(v) as dims, round({_norm('v')}, 6) as length from w""",
    "cosine_to_masked": f"with {_VECTORS} select key, round(list_dot_product(u.e, m.e) / ({_norm('u.e')} * {_norm('m.e')}), 6) as cosine from u join m using (key)",
    "centroids": f"with {_CENTROIDS} select label, n as numaveraged, generate_subscripts(c, 1) - 1 as i, round(unnest(c), 6) as x from unit",
    "nearest_centroid": f"""with {_CENTROIDS}, d as (
          select e.vec_id, u.label, list_dot_product(cast(e.embedding as double[]), u.c) / {_norm('cast(e.embedding as double[])')} as s from embeddings e, unit u
        )
        select vec_id, cast(label as bigint) as label, round(s, 6) as cosine from d qualify row_number() over (partition by vec_id order by s desc, label) = 1""",
    "similar_pairs_of_lemma": f"""with {_VECTORS}, r as (select key, lu_lemma, e, {_norm('e')} as l from u join {_I} f on f.id = u.key where lu_lemma is not null)
        select a.lu_lemma, a.key as a, b.key as b, round(list_dot_product(a.e, b.e) / (a.l * b.l), 6) as cosine
        from r a join r b on a.lu_lemma = b.lu_lemma and a.key < b.key where list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9""",
    "silhouettes": f"""
        with r as (select vec_id, label, list_transform(cast(embedding as double[]), lambda x: x / {_norm('cast(embedding as double[])')}) as v from embeddings),
        d as (select a.vec_id, a.label, b.label as other, avg(1 - list_dot_product(a.v, b.v)) as d from r a join r b on a.vec_id <> b.vec_id group by 1, 2, 3),
        s as (select vec_id, label, max(case when other = label then d end) as a, min(case when other <> label then d end) as b from d group by 1, 2)
        select vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) as silhouette from s""",
    "run_leaderboard": """
        with runs as (
          select experiment_id, experiment_run_id, max(case when isnan(micro_f1__novelty_frame) then null else micro_f1__novelty_frame end) as score, cast(max(numclusters) as double) as clusters
          from experiment_scores where experiment_id is not null group by 1, 2
        ), ranked as (
          select *, rank() over (partition by experiment_id order by score desc nulls last) as rank_score, rank() over (partition by experiment_id order by clusters desc nulls last) as rank_clusters from runs
        ), averaged as (select *, (rank_score + rank_clusters) / 2.0 as avg_rank from ranked),
        again as (select *, rank() over (partition by experiment_id order by avg_rank) as rank from averaged)
        select experiment_id, experiment_run_id, rank_score, rank_clusters, avg_rank, rank from again where rank <= 10""",
    "run_summary": """
        with v as (select clusterer, case when isnan(clustering_duration) then null else clustering_duration end as x from experiment_scores)
        select clusterer, count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, round(min(x), 6) as min, round(quantile_cont(x, 0.25), 6) as q25,
          round(quantile_cont(x, 0.5), 6) as q50, round(quantile_cont(x, 0.75), 6) as q75, round(max(x), 6) as max from v group by clusterer""",
    "status_counts": "select name, status, count(*) as n from experiment_scores group by name, status",
    "latest_finished_run": """
        select datasetsplit || '/' || clusterer as identity, experiment_run_id from experiment_scores where status = 'finished' and reported_at is not null
        qualify row_number() over (partition by identity order by reported_at desc, experiment_run_id desc) = 1""",
    "scores_by_setting": """
        select try_cast(json_extract_string(setting, '$.alpha') as double) as alpha, try_cast(json_extract_string(setting, '$.seed') as int) as seed, count(*) as n,
          round(avg(case when isnan(micro_f1__novelty_frame) then null else micro_f1__novelty_frame end), 9) as mean
        from experiment_scores where setting is not null group by 1, 2""",
    "label_set_operations": f"""
        with s as (select distinct s.split, s.instance_id, f.frame_label from {_S} s join {_I} f on f.id = s.instance_id where datasetsplit_id = 1 and frame_label is not null),
        a as (select frame_label from s where split = 'train'), b as (select frame_label from s where split = 'test')
        select frame_label, 'union' as part from (select * from a union select * from b) union all select frame_label, 'both' from (select * from a intersect select * from b)
        union all select distinct frame_label, 'except_all' from (select * from a except all select * from b) union all select frame_label, 'test_only' from (select * from b except select * from a)""",
    "development_stats": f"""
        with units as (select count(distinct id) as n from {_I} where lu_lemma is not null and frame_label is not null group by lu_lemma, frame_label)
        select cast(sum(n) as bigint) as n, count(*) as n_units, cast(sum(n * (n - 1) / 2) as bigint) as n_pairs from units""",
    "corpus_without_proto_frames": f"""
        select i, frame_id, split, case when split = 'train' then 'F' || frame_id end as fixed_label,
          coalesce(array_to_string(list_transform(string_split(nullif(trim(lu_index_part), ''), ','), lambda x: cast(cast(cast(x as double) as int) as varchar)), ','), '') as lu_index_part
        from ({_SALSA})""",
    "unified_corpus": f"""
        with r as (select *, case when frame_id is null then '<unk>' else 'salsa2.0::' || frame_id end as label, regexp_split_to_array(coalesce(tokenized_sentence, ''), '\\s+') as tokens from ({_SALSA}))
        select i, lu_lemma, label as frame_label,
          concat_ws('::', 'salsa2.0', global_sentence_id, '[' || coalesce(lu_index, '') || ']', substr('[''' || array_to_string(tokens, ''',''') || ''']', 1, 20), replace(coalesce(lu_lemma_full, lu_lemma), ' ', '_'), label) as global_id
        from r""",
    "alternative_split": "select i, data_source, case data_source when 'SALSA2-ADD' then 'dev' when 'SALSA2-WEB' then 'test' else 'train' end as split from salsa",
    "import_new_instances": f"select id, global_id from {_IMPORTED} where global_id not in (select global_id from frameinstances where dataset_id = 1 and global_id is not null)",
    "update_instances": f"""
        select global_id, coalesce(arg_max_null(frame_label, id), arg_min_null(frame_label, id)) as frame_label, max(id) as id from {_I} group by global_id""",
    "missing_vectors": f"with {_VECTORS} select id as key from frameinstances where id not in (select key from u)",
    "copied_vectors": f"""with {_VECTORS}
        select t.id as key, round({_norm('arg_min(m.e, m.key)')}, 5) as length from m join frameinstances s on s.id = m.key join {_IMPORTED} t using (global_id) group by t.id""",
    "instances_with_vectors": f"with {_VECTORS} select f.id as key, f.global_id, len(u.e) as dim_unmasked, len(m.e) as dim_masked from frameinstances f left join u on u.key = f.id left join m on m.key = f.id",
    "table_fingerprint": f"""
        with d as (select md5(concat_ws('|', {", ".join(f"length(cast({c} as varchar)) || ':' || cast({c} as varchar)" for c in ("datasetsplit_id", "instance_id", "split"))})) as d from {_S}),
        s as (select count(*) as n, {", ".join(f"cast(sum(cast(cast('0x' || substr(d, {8 * i + 1}, 8) as ubigint) as hugeint)) as varchar) as w{i}" for i in range(4))} from d),
        m as (select n, md5(concat_ws(',', n, w0, w1, w2, w3)) as h from s)
        select n, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) as fingerprint from m""",
    "extracted_vectors": """
        select id as key, 64 as dims, 1.0 as length from frameinstances
        where extrainfo.tokens is not null and len(extrainfo.lu_index) > 0""",
    "masked_sentences": """
        select id, array_to_string(list_transform(extrainfo.tokens, lambda t, i: case when i - 1 = extrainfo.lu_index[1] then '[MASK]' else coalesce(t, '*') end), ' ') as sentence
        from frameinstances where extrainfo.tokens is not null and extrainfo.lu_index is not null""",
    "merge_threshold": f"""with {_CENTROIDS}, d as (select 1 - list_dot_product(a.c, b.c) as d from unit a join unit b on a.label < b.label),
        top as (select d from d order by d desc limit 10)
        select case when count(*) = 10 then round(min(d) + 1e-6, 6) end as threshold from top""",
    "vector_dimensions": "select len(embedding) as dims, count(*) as n from instance_vectors where masking = 'unmasked' group by 1",
    "events_by_day": "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as count from events group by 1, 2",
    "label_members_of_dataset": f"select frame_label as label, id as instance_id from {_I} where dataset_id = 1",
    "label_members_of_splits": _base("select frame_label as label, instance_id from train"),
    "lemma_group_members": _base("select lu_lemma, instance_id from train where lu_lemma in (select lu_lemma from train group by lu_lemma having count(*) >= 5)"),
    "cluster_members": _base("""
        select distinct 1 as clusteringid, clusterid, transitive_label as label_transitive, local_cluster_id, instanceid as instance_id from assignments_ a join clusters_ c on c.id = a.clusterid"""),
    "clusters_with_vectors": f"""with {_VECTORS}, {_BASE}, e as (
          select clusterid, i, avg(u.e[i]) as x, count(*) as n from assignments_ a join u on u.key = a.instanceid, generate_series(1, 64) as s(i) group by clusterid, i
        ), w as (select clusterid, any_value(n) as n, list(x order by i) as v from e group by clusterid)
        select c.id, c.numelems, w.n as numaveraged, round(v[1] / {_norm('v')}, 6) as first_entry from clusters_ c left join w on w.clusterid = c.id""",
    "all_instances_with_assignment": _base(f"select f.id, f.global_id, c.id as clusterid, c.transitive_label from {_I} f left join assignments_ a on a.instanceid = f.id left join clusters_ c on c.id = a.clusterid"),
    "delete_all_clusterings": f"select 2 as clusteringid, count(distinct frame_label) as n_clusters, count(*) as n_assignments from {_I} where frame_label is not null",
    "delete_experiment": "select experiment_id, count(*) as n from experiment_scores where experiment_id is null or experiment_id not in (1003, 1055) group by 1",
    "delete_all_experiments": "select experiment_run_id, reported_at from experiment_scores where experiment_id is null",
    "copied_experiment": """
        select cast(9000 as bigint) as experiment_id, (select max(experiment_run_id) from experiment_scores) + row_number() over (order by experiment_run_id) as experiment_run_id,
          experiment_run_id as copied_from, min(setting) as setting from experiment_scores where experiment_id = 1003 group by experiment_run_id""",
    "list_datasets": f"""
        select d.name as dataset, d.language, n.name as datasetsplit, (select count(distinct instance_id) from {_S} s where s.datasetsplit_id = n.id) as n_instances
        from datasetsplits n join datasets d on d.id = n.dataset_id""",
    "list_experiments": """
        select experiment_id, min(name) as name, count(distinct experiment_run_id) as n_runs, strftime(max(reported_at), '%Y-%m-%d %H:%M:%S') as last_report
        from experiment_scores where experiment_id is not null group by 1""",
    "evaluation_metrics": f"""with {_PREDICTED}, q as (
          select case when gold in (select label from known) then gold else 'outlier' end as g, case when predicted in (select label from known) then predicted else 'outlier' end as h from p
        ), l as (select label from known union all select 'outlier'),
        counted as (select label, (select count(*) from q where g = label and h = label) as tp, (select count(*) from q where h = label) as np, (select count(*) from q where g = label) as ng from l),
        r as (select case when np = 0 then 0.0 else tp / np end as pr, case when ng = 0 then 0.0 else tp / ng end as re, tp, ng from counted),
        m as (select sum(tp) / sum(ng) as mi, avg(pr) as pr, avg(re) as re, avg(case when pr + re = 0 then 0.0 else 2 * pr * re / (pr + re) end) as f from r),
        i as (with {_induction('p')})
        select round(mi, 9) as micro_f1, round(pr, 9) as precision, round(re, 9) as recall, round(f, 9) as macro_f1, purity, inverse_purity, purity_f1, bcubed_precision, bcubed_recall, bcubed_f1 from m, i""",
    "best_settings": """
        with means as (
          select experiment_id, try_cast(json_extract_string(setting, '$.alpha') as double) as alpha, count(s) as n, avg(s) as mean
          from (select *, case when isnan(micro_f1__novelty_frame) then null else micro_f1__novelty_frame end as s from experiment_scores where experiment_id is not null) group by 1, 2 having count(s) > 0
        ), ranked as (select *, rank() over (partition by experiment_id order by round(mean, 9) desc) as rank from means)
        select experiment_id, alpha, n, round(mean, 9) as mean, rank from ranked where rank = 1""",
    "merged_settings": """
        with s as (select json_merge_patch(json_merge_patch(setting, '{"seed":0,"note":"again"}'), '{"dim":64}') as s from experiment_scores where setting is not null)
        select try_cast(json_extract_string(s, '$.alpha') as double) as alpha, cast(json_extract_string(s, '$.seed') as int) as seed, json_extract_string(s, '$.note') as note,
          cast(json_extract_string(s, '$.dim') as int) as dim, count(*) as n from s group by 1, 2, 3, 4""",
    "split_elements": "select split, count(*) as n from (select unnest(list_append(coalesce(splits, []), 'all')) as split from experiment_scores) group by 1",
    "experiment_ages": """
        with s as (select experiment_id, min(reported_at) as a, max(reported_at) as b, datesub('second', min(reported_at), max(reported_at)) as seconds from experiment_scores where experiment_id is not null group by 1)
        select experiment_id, strftime(a, '%Y-%m-%d %H:%M:%S') as began, seconds,
          case when seconds >= 86400 then (seconds // 86400) || case when seconds // 86400 = 1 then ' day ' else ' days ' end else '' end
            || lpad(cast(seconds % 86400 // 3600 as varchar), 2, '0') || ':' || lpad(cast(seconds % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(seconds % 60 as varchar), 2, '0') as age
        from s""",
    "group_fingerprints": _fingerprints("dataset_id", f"select dataset_id as grp, global_id, lu_lemma, frame_label from {_I}", ["global_id", "lu_lemma", "frame_label"]),
    "split_fingerprints": _fingerprints("datasetsplit", f"select d.name as grp, f.global_id, s.split from {_S} s join {_I} f on f.id = s.instance_id join datasetsplits d on d.id = s.datasetsplit_id", ["global_id", "split"]),
    "vector_fingerprints": f"with {_VECTORS} " + _fingerprints("datasetsplit", f"""
        select d.name as grp, f.global_id, array_to_string(list_transform(u.e, lambda x: cast(cast(floor(x * 1e6 + 0.5) as bigint) as varchar)), ',') as embedding
        from u join {_S} s on s.instance_id = u.key join {_I} f on f.id = u.key join datasetsplits d on d.id = s.datasetsplit_id""", ["global_id", "embedding"]),
    "alternative_splits": """
        select 'salsa2.0-altsplit-' || n as datasetsplit, i,
          case when data_source = 'SALSA2-ADD' then ['dev', 'test', 'train'][n + 1] when data_source = 'SALSA2-WEB' then ['test', 'dev', 'dev'][n + 1] else 'train' end as split
        from salsa, range(3) as r(n)""",
    "forwarded_labels": f"""
        select '#' || coalesce(lu_lemma || '::' || frame_label, cast(id as varchar)) as label, count(*) as n from {_I} where lu_lemma is not null group by 1""",
    "two_step_kept": f"""with {_VECTORS}, r as (
          select f.id, f.frame_label, min(s.split) as split from u join m using (key) join {_I} f on f.id = u.key join {_S} s on s.instance_id = f.id where s.datasetsplit_id <= 3 group by 1, 2
        )
        select count(*) as n_rows, count(*) filter (split = 'train' and frame_label <> '<unk>') as n_labelled, cast(0 as bigint) as moved, cast(0 as bigint) as unassigned from r""",
}
