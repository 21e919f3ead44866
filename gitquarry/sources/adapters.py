"""Logical repository tables derived from the driver's tables.

The driver's parquet files hold no commits or people, so each logical
table of the data model is derived from one of them with expressions that
an SQL engine can repeat (the oracle SQL in ``gitquarry.plans.oracle``
spells out the same derivations).  Every derived table grows with its
source table, so the registered queries scale with the scale factor.

| logical table      | source            |
| ------------------ | ----------------- |
| commit             | events            |
| project            | region            |
| vcs_system         | nation            |
| file_action, hunk  | events            |
| message            | events (view/click/signup) or orders            |
| issue_comment      | events (error/purchase) or lineitem             |
| people             | customer          |
| code_entity_state  | lineitem          |
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.sources.catalog import Catalog


def commits(events: DataFrame) -> DataFrame:
    """commit: one per event; the message text depends on the event type,
    with matching, non-matching, upper-case, unanchored and null texts."""
    e = F.col("event_type")
    message = (
        F.when(e == "signup", F.lit("Merge branch main\n\ninto release"))
        .when(e == "purchase", F.lit("FIXED defect in checkout"))
        .when(e == "error", F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("string"))
              .otherwise(F.lit("typo fix")))
        .when(e == "view", F.lit("Prefix cleanup in view"))
        .otherwise(F.when(F.col("event_id") % 5 == 0, F.lit("Refactor dispatch loop"))
                   .otherwise(F.lit("Add click handler")))
    )
    return events.select(
        F.col("event_id").alias("_id"),
        (F.col("user_id") % 25).alias("vcs_system_id"),
        F.col("user_id").alias("committer_id"),
        # whole hours, so that commits of one file share dates
        F.date_trunc("hour", "ts").cast(events.schema["ts"].dataType).alias("committer_date"),
        message.alias("message"),
    )


def projects(region: DataFrame) -> DataFrame:
    return region.select(F.col("r_regionkey").alias("_id"), F.col("r_name").alias("name"))


def vcs_systems(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").alias("_id"), F.col("n_regionkey").alias("project_id"))


def _file_key() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint") * 10


def file_actions(events: DataFrame, with_value: bool = False) -> DataFrame:
    """file_action: every commit changes one file; every third commit
    changes a second file too, so a fix can span files.  One scan: the
    (one or two) actions of an event are exploded from an array."""
    first = F.struct(
        (F.col("event_id") * 2).alias("_id"),
        (_file_key() + F.col("user_id") % 10).alias("file_id"))
    second = F.struct(
        (F.col("event_id") * 2 + 1).alias("_id"),
        (_file_key() + (F.col("user_id") + 3) % 10).alias("file_id"))
    actions = F.when(F.col("event_id") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    out = events.select(F.col("event_id").alias("commit_id"), "value",
                        F.explode(actions).alias("a")) \
        .select(F.col("a._id").alias("_id"), "commit_id", F.col("a.file_id").alias("file_id"), "value")
    return out if with_value else out.drop("value")


def hunks(events: DataFrame) -> DataFrame:
    """hunk: two per file action, with line numbers from the event value by
    integer arithmetic; some old_start values are -1."""
    fa = file_actions(events, with_value=True)
    v = (F.round(F.col("value") * 100).cast("bigint") + (F.col("_id") % 2) * 37).alias("v")
    fa = fa.select(F.col("_id").alias("file_action_id"), v)
    a = F.struct(
        (F.col("v") % 400).cast("int").alias("new_start"),
        (F.expr("v div 7") % 300).cast("int").alias("old_start"),
        (F.col("v") % 13).cast("int").alias("old_lines"))
    b = F.struct(
        (F.expr("v div 3") % 500).cast("int").alias("new_start"),
        F.when(F.col("v") % 11 == 0, F.lit(-1)).otherwise(F.expr("v div 11") % 350)
        .cast("int").alias("old_start"),
        (F.expr("v div 5") % 9).cast("int").alias("old_lines"))
    return fa.select("file_action_id", F.explode(F.array(a, b)).alias("h")) \
        .select("file_action_id", "h.new_start", "h.old_start", "h.old_lines")


def messages(events: DataFrame) -> DataFrame:
    """message: mailing-list posts; some senders are unknown (null)."""
    return events.filter(F.col("event_type").isin("view", "click", "signup")).select(
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.col("user_id")).alias("from_id"),
        F.col("ts").alias("date"),
    )


def issue_comments(events: DataFrame) -> DataFrame:
    """issue_comment: some authors never post on the mailing list."""
    return events.filter(F.col("event_type").isin("error", "purchase")).select(
        F.when(F.col("event_id") % 89 == 0, F.lit(None).cast("bigint"))
        .when(F.col("user_id") % 7 == 0, F.col("user_id") + 1000)
        .otherwise(F.col("user_id")).alias("author_id"),
        F.col("ts").alias("created_at"),
    )


def volume_messages(orders: DataFrame) -> DataFrame:
    return orders.select((F.col("o_custkey") % 500).alias("from_id"), F.col("o_orderdate").alias("date"))


def volume_comments(lineitem: DataFrame) -> DataFrame:
    return lineitem.select((F.col("l_suppkey") % 500).alias("author_id"),
                           F.col("l_shipdate").alias("created_at"))


def volume_commits(lineitem: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    message = (F.when(flag == "R", F.lit("Fix returned item"))
               .when(flag == "A", F.lit("Accept change")).otherwise(F.lit("New feature")))
    return lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_id"),
        (F.col("l_partkey") % 500).alias("committer_id"),
        F.col("l_shipdate").alias("committer_date"),
        message.alias("message"),
    )


def _letters(tag: str, n: int) -> F.Column:
    # n letters a-p from the person's number
    person = F.expr("c_custkey div 4").cast("string")
    return F.translate(F.substring(F.md5(F.concat(F.lit(tag), person)), 1, n), "0123456789", "ghijklmnop")


def people(customer: DataFrame) -> DataFrame:
    """people: four records of each person (a customer number div 4), which
    write the name and the mailbox differently, so blocks stay small at any
    scale.  Some names are null, some e-mails lack an '@', some mailboxes hold
    a denylisted word, and two blocks of a fixed size share a first name
    (``admin``, and one without Latin letters)."""
    key, variant, person = F.col("c_custkey"), F.col("c_custkey") % 4, F.expr("c_custkey div 4")
    first, last = _letters("f", 8), _letters("l", 7)
    head = F.when(key < 60, F.lit("admin")).when((key < 2000) & (key % 37 == 3), F.lit("\u00e9")).otherwise(first)
    name = F.when(key % 41 == 0, F.lit(None).cast("string")) \
        .when(variant == 1, F.concat(last, F.lit(" "), head)) \
        .when(variant == 2, F.concat(head, F.lit(" "), F.substring(last, 1, 6))) \
        .otherwise(F.concat(head, F.lit(" "), last))
    box = F.when(key % 29 == 5, F.concat(F.lit("list."), first)) \
        .when(variant == 0, F.concat(first, F.lit("."), last)) \
        .when((variant == 1) & (person % 3 == 0), F.concat(first, F.lit("."), last)) \
        .when(variant == 1, F.concat(last, first)) \
        .when(variant == 2, F.concat(F.substring(first, 1, 1), last)) \
        .when(person % 3 == 1, F.concat(last, F.lit("_"), first)) \
        .otherwise(F.concat(first, F.lit("-"), key.cast("string")))
    return customer.select(
        key.alias("_id"), name.alias("name"),
        F.when(key % 17 == 0, box).otherwise(F.concat(box, F.lit("@example.org"))).alias("email"),
        F.col("c_name").alias("username"))


def code_entity_states(lineitem: DataFrame) -> DataFrame:
    """code_entity_state: one entity per line item, metrics in a struct."""
    flag = F.col("l_returnflag")
    return lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_id"),
        F.col("l_orderkey").alias("commit_id"),
        F.col("l_partkey").alias("file_id"),
        F.when(flag == "R", "class").when(flag == "A", "method").otherwise("file").alias("ce_type"),
        F.concat(F.lit("entity"), F.col("l_partkey").cast("string")).alias("long_name"),
        F.struct(
            F.col("l_extendedprice").alias("LOC"),
            F.col("l_quantity").alias("WMC"),
            F.col("l_tax").alias("CBO"),
            F.col("l_discount").alias("NOM"),
        ).alias("metrics"),
    )


def commit_lines(events: DataFrame) -> DataFrame:
    """commit documents as JSON lines: by turns in the camel-case generation,
    with ids and dates in extended form and the ids of the file actions, and
    in the snake-case one.  Some lines are broken off and some lack an id."""
    key = F.col("event_id").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    oid = lambda c: F.named_struct(F.lit("$oid"), c)
    actions = F.when(F.col("event_id") % 3 == 0, F.array(oid(F.concat(F.lit("a"), key)), oid(F.concat(F.lit("b"), key)))) \
        .otherwise(F.array(oid(F.concat(F.lit("a"), key))))
    camel = F.struct(oid(key).alias("_id"), oid(F.col("user_id").cast("string")).alias("committerId"),
                     F.named_struct(F.lit("$date"), F.concat(stamp, F.lit("+0000"))).alias("committerDate"),
                     F.concat(F.lit('say "'), "event_type", F.lit('"\n')).alias("message"), actions.alias("fileActionIds"))
    snake = F.struct(key.alias("_id"), F.col("user_id").alias("committer_id"), F.concat(stamp, F.lit("Z")).alias("committer_date"),
                     F.col("event_type").alias("message"))
    no_id = F.struct(F.col("event_type").alias("message"))
    line = F.when(F.col("event_id") % 50 == 7, F.substring(F.to_json(snake), 1, 20)).when(F.col("event_id") % 50 == 9, F.to_json(no_id)) \
        .when(F.col("event_id") % 2 == 0, F.to_json(camel)).otherwise(F.to_json(snake))
    return events.select(line.alias("line"))


def file_action_lines(events: DataFrame) -> DataFrame:
    """file_action documents: those of snake-case commits hold the commit's id,
    the others are listed by it."""
    key, even = F.col("event_id").cast("string"), F.col("event_id") % 2 == 0
    file_id = (_file_key() + F.col("user_id") % 10).cast("string")
    camel = lambda tag: F.struct(F.named_struct(F.lit("$oid"), F.concat(F.lit(tag), key)).alias("_id"),
                                 F.named_struct(F.lit("$oid"), file_id).alias("fileId"), F.lit("M").alias("mode"))
    snake = F.struct(F.concat(F.lit("a"), key).alias("_id"), key.alias("commit_id"), file_id.alias("file_id"), F.lit("M").alias("mode"))
    own = F.when(~even, F.array(F.to_json(snake))).when(F.col("event_id") % 3 == 0, F.array(F.to_json(camel("a")), F.to_json(camel("b")))) \
        .otherwise(F.array(F.to_json(camel("a"))))
    return events.select(F.explode(own).alias("line"))


class RepoTables:
    """All logical tables of one scale-factor folder, derived lazily."""

    def __init__(self, spark, root: str):
        self.cat = Catalog(spark, root)

    def t(self, name: str) -> DataFrame:
        return self.cat.load(name)

    def commits(self):
        return commits(self.t("events"))

    def projects(self):
        return projects(self.t("region"))

    def vcs_systems(self):
        return vcs_systems(self.t("nation"))

    def file_actions(self):
        return file_actions(self.t("events"))

    def hunks(self):
        return hunks(self.t("events"))

    def messages(self):
        return messages(self.t("events"))

    def issue_comments(self):
        return issue_comments(self.t("events"))

    def people(self):
        return people(self.t("customer"))

    def code_entity_states(self):
        return code_entity_states(self.t("lineitem"))
