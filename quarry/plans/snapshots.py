"""Queries over manifest_entries: changes between full snapshots."""

from quarry.operators import snapshot_diff
from quarry.sources.tables import table


def p3_found(spark, folder):
    return snapshot_diff.snapshot_changes(table(spark, folder, "manifest_entries"))


def p3_change_counts(spark, folder):
    return snapshot_diff.change_counts(table(spark, folder, "manifest_entries"))


#: The changes in SQL, by set differences rather than by a merge.
CHANGES_SQL = r"""
with plain as (
  select repo, snapshot_no,
         regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '^(\./)+', '') as path,
         nullif(trim(regexp_replace(lower(trim(content_hash)), '^sha256:', '')), '') as digest, loaded_at
  from manifest_entries where repo is not null and snapshot_no is not null),
held as (
  select repo, snapshot_no, path, digest from plain where path <> ''
  qualify row_number() over (partition by repo, snapshot_no, path order by loaded_at desc nulls last, digest desc nulls last) = 1),
steps as (
  select repo, snapshot_no as old_no, lead(snapshot_no) over (partition by repo order by snapshot_no) as new_no
  from (select distinct repo, snapshot_no from plain)),
changes as (
  select s.repo, s.new_no as snapshot_no, h.path, 'removed' as change_kind
  from steps s join held h on h.repo = s.repo and h.snapshot_no = s.old_no
  where s.new_no is not null
    and not exists (select 1 from held n where n.repo = h.repo and n.path = h.path and n.snapshot_no = s.new_no)
  union all
  select s.repo, s.new_no, h.path, 'added'
  from steps s join held h on h.repo = s.repo and h.snapshot_no = s.new_no
  where not exists (select 1 from held o where o.repo = h.repo and o.path = h.path and o.snapshot_no = s.old_no)
  union all
  select s.repo, s.new_no, n.path, 'changed'
  from steps s join held o on o.repo = s.repo and o.snapshot_no = s.old_no
  join held n on n.repo = s.repo and n.snapshot_no = s.new_no and n.path = o.path
  where o.digest <> n.digest)
"""

QUERIES = {"p3_found": p3_found, "p3_change_counts": p3_change_counts}
ORACLES = {
    "p3_found": CHANGES_SQL + "select repo, snapshot_no::int as snapshot_no, path, change_kind from changes",
    "p3_change_counts": CHANGES_SQL
    + """select repo, snapshot_no::int as snapshot_no, count(*) filter (change_kind = 'added') as added,
  count(*) filter (change_kind = 'removed') as removed, count(*) filter (change_kind = 'changed') as changed
  from changes group by repo, snapshot_no""",
}
