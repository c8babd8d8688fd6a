"""python -m wikiloom.cli index | evaluate | search | segment, over files of relations."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from wikiloom import config as C
from wikiloom.api import Passages, Queries, Retriever, TripleDataset
from wikiloom.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wikiloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("index", "encode the passages not yet in the index"), ("evaluate", "recall and MRR of all modes"), ("search", "ranked passages of the queries"), ("segment", "passages of raw pages (JSON lines)")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--config")
        for f in fields(C.Config):
            kind = {"int": int, "float": float}.get(str(f.type).split(" ")[0], str)
            s.add_argument(f"--{f.name.replace('_', '-')}", type=kind)
        s.add_argument("--mode", default="full", choices=["tf_idf", "rerank", "full"])
        s.add_argument("--pages", help="folder of raw pages, for segment")
        s.add_argument("--out", help="folder for the result; printed without it")
        s.add_argument("--master")
    return p


def run(argv: list[str] | None = None, spark=None):
    a = parser().parse_args(argv)
    config = C.load(a.config) if a.config else C.Config()
    config = replace(config, **{f.name: v for f in fields(C.Config) if (v := getattr(a, f.name)) is not None})
    spark = spark or session("wikiloom", a.master)
    if a.command == "segment":
        from wikiloom.operators.segment import segment_pages
        from wikiloom.sources.files import json_lines

        out = segment_pages(json_lines(spark, a.pages), "id", "text")
    else:
        r = Retriever(Passages.read(spark, config.passages_path), config)
        if a.command == "index":
            out = r.index.groupBy("scope").count()
        elif a.command == "search":
            out = r.search(Queries.read(spark, config.queries_path).df, a.mode)
        else:
            out = r.evaluate(TripleDataset.read(spark, config))
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
    else:
        out.show(50, truncate=False)
    return out


if __name__ == "__main__":
    run()
