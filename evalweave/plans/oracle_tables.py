"""The bindings as SQL common table expressions, for the oracle side."""

from __future__ import annotations

from evalweave.plans.bindings import planted_sql

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "eval_row": ((), f"""
        SELECT CAST(user_id AS VARCHAR) AS pack_id, CAST(event_id % 4 AS VARCHAR) AS task_id,
          CASE WHEN event_type = 'view' THEN 'prompt_only' ELSE event_type END AS mode,
          CASE WHEN {K} % 10 = 0 THEN 'model_error' ELSE 'success' END AS status,
          CASE WHEN {K} % 10 <> 0 THEN value END AS overall_score,
          event_id AS seq, 'e' AS evaluator_kind, CAST(user_id % 3 AS VARCHAR) AS judge_model,
          {K} AS k
        FROM events"""),
    "heldout": ((), """
        SELECT DISTINCT CAST(user_id AS VARCHAR) AS pack_id, t.pos, CAST(t.pos AS VARCHAR) AS task_id
        FROM events, (VALUES (0), (1), (2), (3)) t(pos)"""),
    "expected": (("heldout",), """
        SELECT pack_id, task_id, m.mode FROM heldout,
          (VALUES ('prompt_only'), ('click'), ('purchase'), ('signup'), ('never_run')) m(mode)"""),
    "cells": (("eval_row",), """
        SELECT pack_id, task_id, mode, arg_max(overall_score, seq) FILTER (status = 'success') AS score,
          bool_or(status = 'success') AS has_success, count(*) AS n_rows
        FROM eval_row GROUP BY ALL"""),
    "generation_log": ((), f"""
        SELECT CAST(user_id AS VARCHAR) AS job_id, sha256(event_type) AS prompt_sha256,
          CAST(user_id % 50 AS VARCHAR) AS pack_id, CAST(user_id AS VARCHAR) AS example_id,
          event_id AS seq,
          CASE WHEN {K} % 10 = 1 THEN 'length' ELSE 'stop' END AS finish_reason,
          CASE {K} % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'rejected_incomplete_generation'
            WHEN 2 THEN 'rejected_private_leak' ELSE 'success' END AS status,
          'v' || CAST({K} % 2 AS VARCHAR) AS prompt_template_version,
          'model' || CAST({K} % 3 AS VARCHAR) AS model,
          ts AS finished_at
        FROM events"""),
    "generation_text": (("generation_log",), f"""
        SELECT g.*, CASE WHEN g.status = 'success' THEN {planted_sql("d.text", "g.seq")} END AS desired_output
        FROM generation_log g
        LEFT JOIN documents d ON d.doc_id = g.seq % (SELECT count(*) FROM documents)"""),
    "job": ((), """
        SELECT CAST(user_id AS VARCHAR) AS job_id, sha256(event_type) AS prompt_sha256,
          CAST(user_id % 50 AS VARCHAR) AS pack_id, CAST(user_id AS VARCHAR) AS example_id,
          'src' || CAST(user_id % 2 AS VARCHAR) AS source, 'write ' || event_type AS prompt,
          user_id * 10 + length(event_type) AS seq
        FROM (SELECT DISTINCT user_id, event_type FROM events
              UNION ALL
              SELECT DISTINCT user_id + 1000000, event_type FROM events WHERE user_id < 10)"""),
}


def with_tables(names: str, body: str) -> str:
    """``WITH`` the named tables and what they need, then ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = TABLES[name]
        for dep in deps:
            add(dep)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}"
