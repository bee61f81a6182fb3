"""Registered queries of catalogs, protocol rules, schemas and maintenance.

Their rows are derived from the given tables, and each twin computes the same
from them in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import decode, lsn
from driftline.operators import apply, ddl, protocol, schema, sinks, state, validate
from driftline.plans import maintenance
from driftline.queries import FULL, FULL_LEGS, LOG, change_log, legs_of, query, table
from driftline.sources import catalog, copy_text

# Catalogs of partitioned tables: a chain as deep as there are nations, and a
# tree of three children each over the customers.

_TREE = """tree as (select cast(-n_nationkey as integer) as parent_id, cast(-n_nationkey - 1 as integer) as child_id from nation
  union all select cast(c_custkey // 3 as integer), cast(c_custkey as integer) from customer where c_custkey >= 3)"""
_ROOTS = f"""{_TREE}, up as (select child_id as table_id, parent_id as root_id from tree
  union all select u.table_id, t.parent_id from up u join tree t on u.root_id = t.child_id),
roots as (select table_id, root_id from up where root_id not in (select child_id from tree))"""


def _tree(spark, sf_dir):
    chain = table(spark, sf_dir, "nation").select((-F.col("n_nationkey")).cast("int").alias("parent_id"), (-F.col("n_nationkey") - 1).cast("int").alias("child_id"))
    customers = table(spark, sf_dir, "customer").where("c_custkey >= 3")
    return chain.unionByName(customers.select(F.expr("cast(c_custkey div 3 as int)").alias("parent_id"), F.col("c_custkey").cast("int").alias("child_id")))


@query(f"with recursive {_ROOTS} select table_id, root_id from roots")
def partition_roots(spark, sf_dir):
    return catalog.roots(_tree(spark, sf_dir))


@query(f"with recursive {_ROOTS} select root_id, table_id from roots where table_id not in (select parent_id from tree)")
def leaf_partitions(spark, sf_dir):
    return catalog.leaves(_tree(spark, sf_dir))


@query(f"""with recursive {_ROOTS}, keys as (select child_id as table_id, [child_id % 3 + 1, 7] as attnums from tree where child_id % 4 = 0 union all select * from (values (0, [2, 1]), (1, [1]), (2, [3, 2, 1])) r(table_id, attnums)),
every as (select table_id, attnums from keys union all select r.table_id, k.attnums from roots r join keys k on k.table_id = r.root_id where r.table_id not in (select table_id from keys))
select table_id, cast(unnest(range(1, len(attnums) + 1)) as integer) as key_position, unnest(attnums) as attnum from every""")
def effective_primary_key(spark, sf_dir):
    """A partition without a key of its own has its root's."""
    tree = _tree(spark, sf_dir)
    own = tree.where("child_id % 4 = 0").select(F.col("child_id").alias("table_id"), F.array(F.col("child_id") % 3 + 1, F.lit(7)).alias("attnums"))
    tops = spark.createDataFrame([(0, [2, 1]), (1, [1]), (2, [3, 2, 1])], "table_id int, attnums array<int>")
    return catalog.effective_primary_key(own.unionByName(tops), tree)


@query(f"with recursive {_ROOTS} select distinct coalesce(r.root_id, c_custkey % 200) as table_id from customer left join roots r on r.table_id = c_custkey % 200")
def publication_roots(spark, sf_dir):
    """Published partitions count as their root."""
    published = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).cast("int").alias("table_id"))
    return catalog.publication_tables(published, _tree(spark, sf_dir))


@query("select exists (select 1 from orders where o_orderkey in (7, 77, 777) and o_orderstatus = 'F') as present")
def partitioned_probe(spark, sf_dir):
    """Whether a table among some ids has a property."""
    return protocol.any_of(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), (F.col("o_orderstatus") == "F").alias("partitioned")), [7, 77, 777])


@query("select o_orderkey, o_totalprice from orders where o_custkey = (select c_custkey from customer where c_name = 'Customer#000000007')")
def metrics_of_named_table(spark, sf_dir):
    """Metrics by a table's name, its id looked up once."""
    tables = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_id"), F.col("c_name").alias("table_name"))
    metrics = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), "o_orderkey", "o_totalprice")
    return protocol.of_named_table(metrics, tables, "Customer#000000007").select("o_orderkey", "o_totalprice")


@query("""with k as (select o_orderkey as table_id, case when o_orderkey % 5 = 0 then null when o_orderkey % 2 = 0 then [1] else [1, 2] end as key,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 7 < 3 then [1] when o_orderkey % 7 < 5 then [2, 1] else [1, 2, 3] end as identity, case when o_orderkey % 7 >= 5 then 3 else 4 end as columns from orders)
select table_id, case when identity is null then 'missing' when key is not null and list_sort(key) = list_sort(identity) then 'primary_key' when len(identity) = columns then 'full' else 'alternative_key' end as identity,
  case when identity is null then false when key is not null and list_sort(key) = list_sort(identity) then true else len(identity) = columns end as allowed from k""")
def identity_audit(spark, sf_dir):
    """Identity class of each table against what a sink can take."""
    key = F.expr("case when o_orderkey % 5 = 0 then null when o_orderkey % 2 = 0 then array(1) else array(1, 2) end")
    identity = F.expr("case when o_orderkey % 7 = 0 then null when o_orderkey % 7 < 3 then array(1) when o_orderkey % 7 < 5 then array(2, 1) else array(1, 2, 3) end")
    kind = validate.identity_class(key, identity, F.when(F.col("o_orderkey") % 7 >= 5, 3).otherwise(4))
    audit = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), kind.alias("identity"))
    return audit.withColumn("allowed", F.col("identity").isin("primary_key", "full"))


@query("""select p_size as snapshot_id, p_partkey as table_id, p_brand as name, 'text' as type, 2 as ordinal from part union all select p_size, p_partkey, p_name, 'int8', 1 from part""")
def schema_messages(spark, sf_dir):
    """Columns out of the JSON that announces a table's version."""
    column = lambda n, t, o: F.struct(F.col(n).alias("name"), F.lit(t).alias("type"), F.lit(o).alias("ordinal"))
    content = F.to_json(F.struct(F.col("p_partkey").alias("table_id"), F.array(column("p_name", "int8", 1), column("p_brand", "text", 2)).alias("columns")))
    messages = table(spark, sf_dir, "part").select(F.col("p_size").alias("snapshot_id"), content.alias("content"))
    return catalog.columns_of(messages).select("snapshot_id", "table_id", "name", "type", "ordinal")


@query("select p_partkey as table_id, p_size as snapshot_id, '[{\"ordinal\":1,\"name\":\"' || p_brand || '\",\"type\":\"int8\",\"nullable\":false},{\"ordinal\":2,\"name\":\"' || p_type || '\",\"type\":\"text\",\"nullable\":true}]' as columns from part")
def schema_as_json(spark, sf_dir):
    """One JSON array for each table version, columns by ordinal."""
    part = table(spark, sf_dir, "part")
    one = lambda n, t, o, null: part.select(F.col("p_partkey").alias("table_id"), F.col("p_size").alias("snapshot_id"), F.lit(o).alias("ordinal"), F.col(n).alias("name"), F.lit(t).alias("type"), F.lit(null).alias("nullable"))
    return catalog.schema_json(one("p_type", "text", 2, True).unionByName(one("p_brand", "int8", 1, False)))


# Protocol

_NAMED = "case when event_id % 97 = 0 then [event_id % 5, (event_id + 1) % 5, 9] else null end"


@query(f"""with {LOG}, states(table_id, state, lsn) as (values (0, 'ready', null), (1, 'sync_done', 20000), (2, 'data_sync', null), (3, 'sync_done', 90000000)),
marked as (select event_id, commit_lsn, case when event_id % 97 = 0 then 'T' else op end as op, user_id % 5 as t, case when event_id % 97 = 0 then [event_id % 5, (event_id + 1) % 5, 9] end as named from log)
select event_id, op, t as table_id from marked where op <> 'T'
union all select event_id, op, n as table_id from (select event_id, op, commit_lsn, unnest(named) as n from marked where op = 'T') m join states s on s.table_id = n where state = 'ready' or (state = 'sync_done' and lsn <= commit_lsn)""")
def truncates_of_owned_tables(spark, sf_dir):
    """A truncate of several tables concerns those that the worker owns."""
    states = spark.createDataFrame([(0, "ready", None), (1, "sync_done", 20000), (2, "data_sync", None), (3, "sync_done", 90_000_000)], "table_id long, state string, lsn long")
    e = F.col("event_id")
    cut = e % 97 == 0
    marked = change_log(spark, sf_dir).select("event_id", "commit_lsn", F.when(cut, "T").otherwise(F.col("op")).alias("op"), (F.col("user_id") % 5).alias("table_id"), F.when(cut, F.array(e % 5, (e + 1) % 5, F.lit(9).cast("long"))).alias("truncated"))
    return protocol.split_truncates(marked, F.broadcast(states)).select("event_id", "op", "table_id")


@query("select event_id from events where user_id % 5 = 3 or (event_id % 97 = 0 and (event_id % 5 = 3 or (event_id + 1) % 5 = 3))")
def events_of_table(spark, sf_dir):
    """A table's events and the truncates that name it."""
    e = F.col("event_id")
    log = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("table_id"), F.when(e % 97 == 0, F.array(e % 5, (e + 1) % 5)).alias("truncated"))
    return protocol.of_table(log, 3).select("event_id")


@query("select event_id, case when user_id % 3 = 0 and event_type = 'view' then 'note,props' when user_id % 3 = 0 then 'note' else 'props' end as violated from events where user_id % 3 = 0 or event_type = 'view'")
def null_violations(spark, sf_dir):
    """Tuples with a NULL where the source declares none."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.lit("x")).alias("note"), F.when(F.col("event_type") != "view", F.col("props")).alias("props"))
    return protocol.null_violations(e, ["note", "props"]).select("event_id", "violated")


@query("select event_id, user_id, event_type from events")
def values_required(spark, sf_dir):
    """Columns declared NOT NULL are checked while rows pass."""
    return protocol.require_values(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id", "event_type"])


@query(f"with {FULL} select event_id, op, new_k as k, value from log")
def strict_sink_rows(spark, sf_dir):
    """The log for a sink that takes full images alone: completed ones pass."""
    changes = change_log(spark, sf_dir, True).withColumns({"new_kind": F.when(F.col("is_partial"), "partial").otherwise("full"), "old_kind": F.when(F.col("op") == "D", "full")})
    return sinks.strict_images(changes, "iceberg").select("event_id", "op", F.col("new_k").alias("k"), "value")


@query(f"""with {LOG}, k as (select event_id, op, case when is_partial then 'partial' else 'full' end as new_kind, case when user_id % 2 = 0 then 'full' when user_id % 3 = 0 then 'key' end as old_kind from log),
d(destination, images) as (values ('bigquery', ['full', 'key']), ('clickhouse', ['full', 'key']), ('iceberg', ['full']), ('snowflake', ['full', 'key']))
select destination, cast(count(*) as bigint) as rejected from k, d where (op in ('I', 'U') and new_kind <> 'full') or (op = 'D' and coalesce(not list_contains(images, old_kind), true)) group by destination""")
def rejected_images(spark, sf_dir):
    """Events that each destination can't take, by its rules of images."""
    k = change_log(spark, sf_dir).select("op", F.when(F.col("is_partial"), "partial").otherwise("full").alias("new_kind"), F.when(F.col("user_id") % 2 == 0, "full").when(F.col("user_id") % 3 == 0, "key").alias("old_kind"))
    counts = k.agg(*(F.count_if(sinks.image_rejected(d)).alias(d) for d in sorted(sinks.DELETE_IMAGES)))
    return counts.select(F.explode(F.create_map(*(x for d in sorted(sinks.DELETE_IMAGES) for x in (F.lit(d), F.col(d))))).alias("destination", "rejected"))


@query(f"""with {LOG}, p as (select user_id as table_id, max(commit_lsn) as durable from log group by 1), n as (select user_id as table_id, min(commit_lsn) as needed from log where event_id % 11 = 0 group by 1)
select p.table_id, least(durable, coalesce(needed, durable)) as retain_lsn from p left join n using (table_id)""")
def retention_bounds(spark, sf_dir):
    changes = change_log(spark, sf_dir)
    needed = changes.where("event_id % 11 = 0").select(F.col("user_id").alias("table_id"), F.col("commit_lsn").alias("snapshot_id"))
    return protocol.retention_bounds(changes.select(F.col("user_id").alias("table_id"), F.col("commit_lsn").alias("flush_lsn")), needed)


@query(f"""with {LOG}, b as (select user_id as table_id, row_number() over (partition by user_id order by seq) as batch, octet_length(encode(props)) * 4000000 as size, event_id % 70 as lag from log),
c as (select *, greatest(batch - lag, 0) as durable, sum(size) over (partition by table_id order by batch rows unbounded preceding) as total from b)
select c.table_id, c.batch, cast(c.batch - c.durable as bigint) as open_batches, cast(c.total - coalesce(d.total, 0) as bigint) as open_bytes, c.batch - c.durable >= 64 or c.total - coalesce(d.total, 0) >= 268435456 as wait from c left join c d on d.table_id = c.table_id and d.batch = c.durable""")
def pending_window(spark, sf_dir):
    """Batches accepted and not yet durable, and when intake waits."""
    from pyspark.sql import Window

    batch = F.row_number().over(Window.partitionBy("table_id").orderBy("seq")).cast("long")
    b = change_log(spark, sf_dir).select(F.col("user_id").alias("table_id"), "seq", (F.octet_length("props") * 4_000_000).cast("long").alias("size"), (F.col("event_id") % 70).alias("lag")).withColumn("batch", batch)
    b = b.withColumn("durable", F.greatest(F.col("batch") - F.col("lag"), F.lit(0)).cast("long"))
    return protocol.pending_window(b, "table_id", "batch", "size", "durable").select("table_id", "batch", "open_batches", "open_bytes", "wait")


@query("select event_id, case when event_id % 3 = 0 then event_id * 8 else least(event_id * 8 - 100, event_id * 8) end as effective from events")
def effective_flush(spark, sf_dir):
    """With nothing in flight, what was received counts as flushed."""
    received = F.col("event_id") * 8
    return table(spark, sf_dir, "events").select("event_id", protocol.effective_flush(received, received - 100, F.col("event_id") % 3).alias("effective"))


@query("with s as (select s_suppkey, case when s_suppkey % 10 = 0 then 'lost' when s_suppkey % 3 = 0 then 'extended' else 'reserved' end as wal_status from supplier) select p_partkey as table_id, 'reset' as action from part where p_partkey % 100 in (select s_suppkey from s where wal_status = 'lost')")
def lost_slots(spark, sf_dir):
    """Tables behind a slot that the source dropped are copied again."""
    s = F.col("s_suppkey")
    slots = table(spark, sf_dir, "supplier").select(s.cast("string").alias("slot_name"), F.when(s % 10 == 0, "lost").when(s % 3 == 0, "extended").otherwise("reserved").alias("wal_status"))
    tables = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), (F.col("p_partkey") % 100).cast("string").alias("slot_name"))
    return protocol.lost_slots(slots, tables, "recreate")


@query("""with f as (select user_id as table_id, cast(row_number() over (partition by user_id order by event_id) as bigint) as attempt, case event_type when 'error' then 'none' when 'view' then 'manual' else 'timed' end as kind from events)
select table_id, attempt, case when kind = 'timed' and attempt < 5 then 'wait_and_roll_back' when kind in ('timed', 'manual') then 'manual' else 'no_retry' end as action, case when kind = 'timed' and attempt < 5 then cast(10000 as bigint) else cast(0 as bigint) end as wait_ms from f""")
def retry_steps(spark, sf_dir):
    from pyspark.sql import Window

    kind = F.when(F.col("event_type") == "error", "none").when(F.col("event_type") == "view", "manual").otherwise("timed")
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return protocol.retry_steps(table(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), attempt.alias("attempt"), kind.alias("kind")))


@query("select o_custkey as table_id, o_orderkey as snapshot_id from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) t where n <= 2")
def newest_versions(spark, sf_dir):
    """The two newest versions of each table stay."""
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("snapshot_id"))
    return protocol.newest(versions, "table_id", "snapshot_id")


_FNV = "list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), cast(2 * i - 1 as integer), 2))::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"


@query(f"select n_nationkey, lpad(lower(to_hex({_FNV.format('n_name')})), 16, '0') as hash from nation union all select -1 - r_regionkey, lpad(lower(to_hex({_FNV.format('r_name')})), 16, '0') from region")
def stable_hash(spark, sf_dir):
    """FNV-1a of identifiers."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    more = table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).alias("n_nationkey"), F.col("r_name").alias("name"))
    return names.unionByName(more).select("n_nationkey", protocol.fnv1a(F.col("name")).alias("hash"))


# Decoding

@query("select l_orderkey, l_linenumber, case when l_linenumber = 7 then null else cast(l_extendedprice as decimal(15,2)) end as price, case when l_linenumber = 6 then 'NaN' else cast(cast(l_discount as decimal(6,4)) as varchar) end as discount from lineitem")
def copy_numeric(spark, sf_dir):
    """Bounded numerics are exact decimals, NaN among them NULL; others keep
    their text."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    price = F.when(F.col("l_linenumber") == 7, "NaN").otherwise(F.col("l_extendedprice").cast("decimal(15,2)").cast("string"))
    discount = F.when(F.col("l_linenumber") == 6, "NaN").otherwise(F.col("l_discount").cast("decimal(6,4)").cast("string"))
    line = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), price, discount)
    return copy_text.decode_copy(l.select(line.alias("value")), [("l_orderkey", "int8"), ("l_linenumber", "int4"), ("price", "numeric(15,2)"), ("discount", "numeric")]).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("""select p_partkey as id, case p_partkey % 8 when 0 then p_name when 1 then null when 2 then cast(p_size as varchar) when 3 then 'true' when 4 then '2020-01-02' when 5 then null when 6 then '{}' else '-' || cast(p_size as varchar) || '.50' end as literal from part""")
def default_literals(spark, sf_dir):
    """Default expressions of columns as literals, NULL where they compute."""
    from driftline.functions.defaults import parse_defaults

    size, name = F.col("p_size").cast("string"), F.concat(F.lit("'"), F.col("p_name"), F.lit("'"))
    forms = [(name, "text"), (F.lit("nextval('s'::regclass)"), "int4"), (F.concat(F.lit("(("), size, F.lit(")::bigint)")), "int8"), (F.lit("true"), "bool"), (F.lit("'2020-01-02'::date"), "date"), (F.lit("now()"), "timestamp"), (F.lit("'{}'::jsonb"), "jsonb"), (F.concat(F.lit("-"), size, F.lit(".50")), "numeric")]
    pick = lambda i: F.expr(f"case {' '.join(f'when p_partkey % 8 = {k} then x[{k}]' for k in range(8))} end") if i else None
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(*(f for f, _ in forms)).alias("x"))
    kinds = F.element_at(F.array(*(F.lit(t) for _, t in forms)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return parse_defaults(p.select(F.col("p_partkey").alias("id"), pick(1).alias("expression"), kinds.alias("type"))).select("id", "literal")


# Schema changes of destinations

@query("select o_orderkey, o_orderstatus as state, cast(null as varchar) as email from orders")
def interrupted_schema_change(spark, sf_dir):
    """A diff's steps, broken off after the first and run again from the
    start: a rename, a drop and an added column."""
    old = (schema.Column("o_orderkey", "int8", 1, 0, False), schema.Column("o_orderstatus", "text", 2), schema.Column("o_totalprice", "float8", 3))
    new = (schema.Column("o_orderkey", "int8", 1, 0, False), schema.Column("state", "text", 2), schema.Column("email", "text", 4))
    rows, types = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), {"int8": "bigint", "text": "string", "float8": "double"}
    store, steps = state.MemoryStore(), schema.plan_steps(old, new, "lake")
    ddl.in_bracket(store, 1, schema.TableSchema(1, "public", "orders", old, 1), lambda a, b: None)
    at = {"rows": rows}

    def work(before, after, stop):
        at["rows"] = ddl.apply_steps(at["rows"], schema.plan_steps(before, after, "lake")[: 1 if stop else None], types)
        if stop:
            raise InterruptedError

    target = schema.TableSchema(1, "public", "orders", new, 2)
    try:
        ddl.in_bracket(store, 1, target, lambda a, b: work(a, b, True))
    except InterruptedError:
        pass
    assert store.metadata[1]["status"] == "applying" and len(steps) > 1
    ddl.in_bracket(store, 1, target, lambda a, b: work(a, b, False))
    return at["rows"].select("o_orderkey", "state", "email")


@query("select o_custkey as table_id, case when o_orderkey % 2 = 0 then 'applied' else 'applying' end as status, o_orderkey as snapshot_id from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) t where n = 1")
def destination_metadata(spark, sf_dir):
    """The last note of each destination table."""
    o = F.col("o_orderkey")
    return ddl.latest_metadata(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), o.alias("id"), F.when(o % 2 == 0, "applied").otherwise("applying").alias("status"), o.alias("snapshot_id")))


@query("with p as (select 'p' || cast(c_nationkey as varchar) as publication, c_custkey as table_id from customer where c_nationkey <> 3 union select 'p3', c_custkey from customer where c_custkey in (1, 2)) select r.name as publication, cast(count(p.table_id) as bigint) as tables, coalesce(string_agg(distinct c.c_name, ',' order by c.c_name), '') as names from (select 'p' || cast(n_nationkey as varchar) as name from nation) r left join p on p.publication = r.name left join customer c on c.c_custkey = p.table_id group by r.name")
def publication_listing(spark, sf_dir):
    """Publications after a drop of one's tables and an addition of others."""
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("publication"))
    customers = table(spark, sf_dir, "customer")
    members = customers.select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("publication"), F.col("c_custkey").cast("long").alias("table_id"))
    members = ddl.add_tables(ddl.drop_tables(members, "p3"), "p3", [1, 2])
    return ddl.list_publications(names, members, customers.select(F.col("c_custkey").cast("long").alias("table_id"), F.col("c_name").alias("table_name")))


@query("""with r as (select c_custkey as role, c_custkey % 11 = 0 as su, c_custkey % 2 = 0 as repl, c_custkey % 3 > 0 as login, c_acctbal > 0 as sel from customer)
select role, 'replication' as problem from r where not su and not repl union all select role, 'login' from r where not su and not login union all select role, 'select' from r where not su and not sel""")
def role_audit(spark, sf_dir):
    """What source roles lack to replicate."""
    k = F.col("c_custkey")
    return ddl.role_audit(table(spark, sf_dir, "customer").select(k.alias("role"), (k % 11 == 0).alias("superuser"), (k % 2 == 0).alias("replication"), (k % 3 > 0).alias("can_login"), (F.col("c_acctbal") > 0).alias("can_select")))


# State

@query("select c_custkey as table_id, 'purge' as action from customer where c_custkey not in (select o_custkey from orders) union all select distinct o_custkey, 'init' from orders where o_custkey % 4 = 1 and o_custkey not in (select c_custkey from customer where c_custkey % 4 <> 1)")
def publication_diff(spark, sf_dir):
    """Tables new to the publication, and those no longer in it."""
    published = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id")).distinct()
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_id"))
    bought = customers.join(published, "table_id", "left_anti")
    return state.publication_changes(published, customers.where("table_id % 4 <> 1").unionByName(bought.where("table_id % 4 = 1")))


@query("with h as (select unnest(range(10 * (select count(*) from nation))) as i) select cast(i % 7 as bigint) as table_id, cast(i as bigint) as id, 'row ' || cast(i as varchar) as payload from h")
def bulk_fill(spark, sf_dir):
    """Generated rows for load tests."""
    return copy_text.bulk_fill(spark, 10 * table(spark, sf_dir, "nation").count(), 7)


# Maintenance

@query("""with s as (select count(*) as snapshots, min(epoch_ms(cast(o_orderdate as timestamp))) as oldest from orders), f as (select count(*) as scheduled_files, cast(sum(cast(l_quantity * 1000 as bigint)) as bigint) as scheduled_bytes from lineitem where l_returnflag = 'R')
select snapshots, cast((1800000000000 - oldest) // 1000 as bigint) as oldest_snapshot_seconds, scheduled_files, scheduled_bytes from s, f""")
def catalog_metrics(spark, sf_dir):
    snapshots = table(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms"))
    scheduled = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_quantity") * 1000).cast("long").alias("file_bytes"))
    return maintenance.catalog_metrics(snapshots, scheduled, 1_800_000_000_000)


_MARKS = "m as (select event_id, cast(user_id as varchar) as table_name, case when event_type = 'signup' then 'copy_complete' else 'copy' end as kind, event_id % 4 as replay_epoch from events), s as (select distinct cast(user_id as varchar) as table_name, user_id % 3 = 0 as streaming, user_id % 3 < 2 as copy_complete, user_id % 4 as epoch from events)"


@query(f"with {_MARKS} select event_id, m.table_name, kind, replay_epoch from m join s using (table_name) where case when streaming then true when copy_complete then kind <> 'copy_complete' else replay_epoch < epoch end")
def marker_cleanup(spark, sf_dir):
    """Applied-batch markers that are no longer needed."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    markers = e.select("event_id", u.cast("string").alias("table_name"), F.when(F.col("event_type") == "signup", "copy_complete").otherwise("copy").alias("kind"), (F.col("event_id") % 4).alias("replay_epoch"))
    phases = e.select(u.cast("string").alias("table_name"), (u % 3 == 0).alias("streaming"), (u % 3 < 2).alias("copy_complete"), (u % 4).alias("replay_epoch")).distinct()
    return maintenance.stale_markers(markers, phases)


@query("""select event_id, case when event_id % 13 = 0 then 'active_run' when event_id % 400 < 300 then 'cooldown' when event_id % 2 = 0 and (event_id % 8) & (user_id % 8) = user_id % 8 then 'covered' when event_id % 2 = 0 then 'merged' else 'created' end as outcome from events""")
def maintenance_requests(spark, sf_dir):
    """What comes of requests: run already, too soon, covered, merged, new."""
    e, pending = F.col("event_id"), F.col("event_id") % 2 == 0
    r = table(spark, sf_dir, "events").select("event_id", (e % 8).alias("have"), (F.col("user_id") % 8).alias("want"))
    return r.select("event_id", maintenance.request_outcome(e % 13 == 0, e % 400 < maintenance.COOLDOWN_SECONDS, pending & maintenance.covers("have", "want"), pending).alias("outcome"))


@query("""with files as (select l_suppkey % 7 as table_id, l_orderkey // 1000 as file, count(*) as rows, count(*) * 9000 as file_bytes from lineitem group by 1, 2),
m as (select table_id, count(*) as files, sum(file_bytes) as bytes, sum(case when file_bytes < 5242880 then 1 else 0 end) as small_files from files group by 1),
p as (select user_id % 9 as table_id, sum(octet_length(encode(props)) * 10000) as bytes from events group by 1), k as (select distinct user_id % 4 as table_id from events where event_type = 'error')
select 0 as step, 'replay_cleanup' as operation, table_id from k union all select 1, 'flush', table_id from p where bytes >= 10000000
union all select 2, 'merge', table_id from (select *, row_number() over (order by table_id) as n from m where files > 1 and (small_files > 0 or bytes / files < 10000000)) t where n <= 4
union all select 3, 'rewrite', table_id from (select *, row_number() over (order by table_id) as n from m where files > 40) t where n <= 4
union all select 4, 'expire', table_id from m union all select 5, 'cleanup', table_id from m""")
def maintenance_plan(spark, sf_dir):
    """A run's operations in their order, each on its eligible tables."""
    files = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("table_id"), F.expr("l_orderkey div 1000").alias("file")).agg(F.count("*").alias("rows"), (F.count("*") * 9000).alias("file_bytes"))
    e = table(spark, sf_dir, "events")
    pending = e.select((F.col("user_id") % 9).alias("table_id"), (F.octet_length("props") * 10_000).alias("bytes"))
    return maintenance.plan_run(maintenance.storage_metrics(files), pending, e.where("event_type = 'error'").select((F.col("user_id") % 4).alias("table_id")), 10_000_000, 4)


@query("select event_id, greatest(1000, least(event_id, 1000 + 2700)) as until from events")
def maintenance_pause(spark, sf_dir):
    """A requested pause ends within its bounds."""
    return table(spark, sf_dir, "events").select("event_id", maintenance.pause_until(F.col("event_id"), F.lit(1000).cast("long")).alias("until"))


@query(f"""with {FULL_LEGS}, folded as (select * from (select *, row_number() over (partition by k order by seq desc, sub desc) as n from legs) t where n = 1 and not deleted) select k, seq, sub, event_type, value from folded""")
def inline_flush(spark, sf_dir):
    """Small deltas folded into the base that an earlier part of the log left."""
    legs = legs_of(change_log(spark, sf_dir, True))
    early = F.expr("seq < '0000000000010000'")
    base = apply.last_writer_wins(legs.where(early), ["k"], ["seq", "sub"], ["event_type", "value"], tombstones=True)
    return maintenance.flush_deltas(base, legs.where(~early), ["k"], ["seq", "sub"], ["event_type", "value"])


# Validation

@query("""with t as (select p_partkey as table_id, case when p_partkey % 6 = 0 then [] when p_partkey % 2 = 0 then ['id'] else ['id', 'b'] end as key, case when p_partkey % 5 = 0 then null when p_partkey % 3 = 0 then ['id', 'b', 'c'] else ['id', 'c'] end as published from part)
select table_id, case when len(key) = 0 then 'no_primary_key' when published is not null and not list_has_all(published, key) then 'key_not_published' else 'ok' end as result from t""")
def primary_key_audit(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id"), F.expr("case when p_partkey % 6 = 0 then cast(array() as array<string>) when p_partkey % 2 = 0 then array('id') else array('id', 'b') end").alias("key"), F.expr("case when p_partkey % 5 = 0 then null when p_partkey % 3 = 0 then array('id', 'b', 'c') else array('id', 'c') end").alias("published"))
    return validate.primary_key_audit(t)


@query("with p as (select distinct o_custkey as t from orders) select c_custkey as table_id, 'not_published' as problem from customer where c_nationkey = 5 and c_custkey not in (select t from p) union all select t, 'generated_column' from p where t % 10 = 3")
def publication_audit(spark, sf_dir):
    """Selected tables that aren't published, published ones with generated
    columns."""
    published = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id")).distinct()
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_id"), "c_nationkey", (F.col("c_custkey") % 10 == 3).alias("generated"))
    return validate.publication_audit(published, customers.where("c_nationkey = 5").select("table_id"), customers.select("table_id", "generated"))


@query("select l_orderkey, l_linenumber, l_quantity - l_discount * 100 >= l_linenumber * 5 as enough from lineitem")
def headroom_audit(spark, sf_dir):
    """Whether limits hold what is used and wanted."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    key = F.to_json(F.struct("l_orderkey", "l_linenumber"))
    out = validate.headroom(l.select(key.alias("setting"), F.col("l_quantity").alias("allowed"), (F.col("l_discount") * 100).alias("used"), (F.col("l_linenumber") * 5).alias("wanted")))
    return out.select(F.get_json_object("setting", "$.l_orderkey").cast("long").alias("l_orderkey"), F.get_json_object("setting", "$.l_linenumber").cast("long").alias("l_linenumber"), "enough")


@query("""with s as (select c_mktsegment || case when c_nationkey % 2 = 0 then '_ms' else '_rate' end as metric, case when c_custkey % 2 = 0 then 'base' else 'new' end as run, c_acctbal + 1000 as v from customer),
m as (select metric, median(case when run = 'base' then v end) as base, median(case when run = 'new' then v end) as new from s group by metric)
select metric, base, new, case when base > 0 then case when metric like '%_ms' then (new - base) * 100 / base > 20 else (base - new) * 100 / base > 15 end else false end as failed from m""")
def regression_gate(spark, sf_dir):
    """Medians of two runs: longer times and lower rates fail."""
    metric = F.concat("c_mktsegment", F.when(F.col("c_nationkey") % 2 == 0, "_ms").otherwise("_rate"))
    run = F.when(F.col("c_custkey") % 2 == 0, "base").otherwise("new")
    return validate.regression_gate(table(spark, sf_dir, "customer").select(metric.alias("metric"), run.alias("run"), (F.col("c_acctbal") + 1000).alias("value")))
