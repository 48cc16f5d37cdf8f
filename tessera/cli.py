"""Command line: named queries, configured clusterings, grids of experiments and their results over a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys

from tessera import __version__

#: Reports of each group of commands, and the query behind each.
REPORTS = {
    "data": {
        "list": "list_datasets", "splits": "instances_in_splits", "labels": "labels_of_dataset", "members": "label_members_of_dataset", "lemmas": "lemma_groups", "fingerprint": "split_fingerprints",
        "vectors": "vector_dimensions", "vector-fingerprint": "vector_fingerprints", "missing": "missing_vectors", "stats": "development_stats", "corpus": "unified_corpus",
    },
    "clustering": {"list": "scored_clusterings", "clusters": "cluster_sizes", "labels": "cluster_sizes_by_transitive_label", "members": "cluster_members", "instances": "all_instances_with_assignment", "vectors": "clusters_with_vectors", "info": "evaluation_metrics"},
    "experiments": {"list": "list_experiments", "status": "status_counts", "scores": "experiment_scores_view", "best": "best_settings", "leaderboard": "run_leaderboard", "ages": "experiment_ages"},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    q = sub.add_parser("query", help="run a query and print or write its rows")
    q.add_argument("name")
    q.add_argument("folder")
    for group, reports in REPORTS.items():
        r = sub.add_parser(group, help=f"reports: {', '.join(reports)}")
        r.add_argument("name", choices=list(reports))
        r.add_argument("folder")
    for name, reader in (("cluster", "two-step clustering of the instances by a configuration (JSON or its file)"), ("run", "run a hyper-parameter grid side by side and score its runs")):
        c = sub.add_parser(name, help=reader)
        c.add_argument("config")
        c.add_argument("folder")
    sub.choices["run"].add_argument("--workers", type=int, default=4)
    for name in ("query", "cluster", "run", *REPORTS):
        sub.choices[name].add_argument("--out", help="a folder for Parquet instead of text")
    g = sub.add_parser("grid", help="the runs of a hyper-parameter grid and its fingerprint")
    g.add_argument("config")
    i = sub.add_parser("inspect", help="what is missing of a grid among the runs of another, or too many")
    i.add_argument("config")
    i.add_argument("other")
    d = sub.add_parser("delete", help="write the runs that are left after some experiments went, or all")
    d.add_argument("folder")
    d.add_argument("out")
    d.add_argument("--experiment", type=int, action="append")
    r = sub.add_parser("results", help="summary of runs by a column")
    r.add_argument("folder")
    r.add_argument("--by", default="clusterer")
    r.add_argument("--metric", default="micro_f1__novelty_frame")
    r.add_argument("--form", choices=("text", "latex", "json"), default="text")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from tessera.plans import experiments

    if a.command == "grid":
        runs = experiments.grid(experiments.load(a.config))
        json.dump({"fingerprint": experiments.experiment_hash(runs), "runs": runs}, sys.stdout, indent=2)
        return 0
    if a.command == "inspect":
        got = experiments.compare(experiments.grid(experiments.load(a.other)), experiments.grid(experiments.load(a.config)))
        json.dump({k: sorted(v) for k, v in got.items()}, sys.stdout, indent=2)
        return 0
    from tessera.operators import leaderboard, views
    from tessera.plans import queries, runner
    from tessera.session import session
    from tessera.sources import results
    from tessera.storage import table

    if a.command == "queries":
        print(*queries.QUERIES, sep="\n")
        return 0
    spark = session(a.master)
    if a.command == "results":
        print(results.render(leaderboard.summary(table(spark, a.folder, "experiment_scores"), a.by, a.metric), a.form))
        return 0
    if a.command == "delete":
        rows = views.delete_experiments(table(spark, a.folder, "experiment_scores"), a.experiment)
    elif a.command == "run":
        rows = runner.run_grid(lambda alpha: queries.clustering_rows(spark, a.folder, alpha), experiments.grid(experiments.load(a.config)), workers=a.workers)
    elif a.command == "cluster":
        rows = queries.two_step_clustering(spark, a.folder, experiments.load(a.config))
    else:
        rows = queries.QUERIES[REPORTS[a.command][a.name] if a.command in REPORTS else a.name](spark, a.folder)
    if a.out:
        rows.write.mode("errorifexists").parquet(a.out)
    else:
        results.write_rows(rows, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
