"""Recall written out in SQL for a fixed number of rounds (for comparison only).

Needs ``m(rowid)`` and ``e(src_id, dst_id)`` and continues their WITH clause.
"""

from __future__ import annotations

from ..sources.schema import RecallConfig


def recall_sql(roots: str, config: RecallConfig, rounds: int, then: str = "select * from recalled") -> str:
    """The result is the table ``recalled``, which ``then`` may read."""
    reach = {0: RecallConfig.reach(config.refs), 1: RecallConfig.reach(config.deps)}
    out = [
        f", r0 as (select distinct * from ({roots}))",
        "g0 as (select graph_id, node_id, 0 as level, null::int as d, null::bigint as parent_id, null::bigint as refcount, row_number() over (partition by graph_id order by node_id) as seq"
        " from r0 where node_id in (select rowid from m))",
        "s0 as (select graph_id, node_id from r0)",
        "f0 as (select * from g0)",
    ]
    takes = ["g0"]
    for n in range(1, rounds + 1):
        p = n - 1
        ref, dep = ("true", "true") if n == 1 else ("f.d = 0", "f.d = 1")
        rank = "pseq, d, child" if n == 1 else "d, pseq, child"
        ok = " or ".join(f"d = {d}" for d in (0, 1) if n <= reach[d]) or "false"
        out += [
            f"c{n} as (select f.graph_id, e.src_id as child, f.node_id as parent_id, f.seq as pseq, 0 as d from f{p} f join e on e.dst_id = f.node_id where {ref}"
            f" union all select f.graph_id, e.dst_id, f.node_id, f.seq, 1 from f{p} f join e on e.src_id = f.node_id where {dep})",
            f"w{n} as (select *, row_number() over (partition by graph_id order by {rank}) as seq from (select *, row_number() over (partition by graph_id, child order by {rank}) as k,"
            f" count(*) over (partition by graph_id, child) as refcount from c{n}) x where k = 1 and not exists (select 1 from s{p} s where s.graph_id = x.graph_id and s.node_id = x.child))",
            f"s{n} as (select * from s{p} union all select graph_id, child from w{n})",
            f"k{n} as (select graph_id, child as node_id, {n} as level, d, parent_id, refcount, seq from w{n} where {ok})",
            f"o{n} as (select graph_id from s{n} group by graph_id having count(*) < {config.memories})",
            f"f{n} as (select * from k{n} where graph_id in (select graph_id from o{n}))",
            f"h{n} as (select graph_id, count(*) as have from ({' union all '.join(f'select graph_id from {t}' for t in takes)}) group by graph_id)",
            f"l{n} as (select k.*, row_number() over (partition by k.graph_id order by refcount desc, d, seq) as place from k{n} k where k.graph_id not in (select graph_id from o{n}))",
            f"t{n} as (select l.graph_id, node_id, level, d, parent_id, refcount, seq from l{n} l left join h{n} h on h.graph_id = l.graph_id where place <= {config.memories} - coalesce(have, 0))",
        ]
        takes += [f"f{n}", f"t{n}"]
    body = " union all ".join(f"select graph_id, node_id, level, d, parent_id, refcount from {t}" for t in takes)
    return (
        ",\n".join(out)
        + f",\nrecalled as (select graph_id, node_id, level, case when level = 0 then 'root' when d = 0 then 'ref' else 'dep' end as dir, parent_id, refcount from ({body}))\n"
        + then
    )
