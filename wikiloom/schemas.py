"""Declared schemas of the relations."""

from __future__ import annotations

RAW_PAGE = "id long, revid long, url string, title string, text string"
CLEAN_PAGE = "id long, revid long, url string, title string, text array<string>"
QA_PAGE = "id long, revid long, url string, title string, text array<string>, positive array<array<string>>, negative array<array<string>>"
PASSAGES = "pid long, passage string, wid long"
QUERIES = "qid long, query string"
TRIPLES_QQP = "qid_pos long, qid_neg long, pid long"
TRIPLES_QPP = "qid long, pid_pos long, pid_neg array<long>"
WIKI_META = "wid long, revid long, url string, title string, pids array<long>"
SEARCH_RESULTS = "query string, passages struct<passage_text:array<string>,is_selected:array<int>>"
RANKED = "scope string, qid long, pid long, score double, rank int"
INDEX = "scope string, pid long, emb array<array<float>>"
