"""Conversations out of message rows (problem 6).

Candidate reply links come from two places: the ids that a row names, and, for rows that
name none that is there, the channel: all earlier mail of the engagement. Links are scored by what the row states, by
time, by mentions and by lexical overlap of whole texts; the likeliest becomes the parent, and link trees grow by
pointer doubling. What a row states outweighs all hints, and sound_conversations uses stated links only, as the
task defines a parent by them; disentangled gives the trees with inferred links too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.mailids import is_blank, message_key, message_keys
from quaystone.operators.deliveries import kept_messages
from quaystone.operators.ranking import spread_row_number
from quaystone.operators.threads import plain_subject
from quaystone.operators.timestamps import to_utc
from quaystone.session import cut

_COLUMNS = ["delivery_id", "engagement_id", "message_id", "in_reply_to", "ref_ids", "subject", "sender", "date_raw", "mailbox_tz", "received_at", "body_text"]
#: A stated link counts more than all hints together, which are at most 1.
STATED = 2.0
#: Weights of time, mention, subject, words in common and repeated lines; an inferred link needs LEAST.
TIME, MENTION, TOPIC, WORDS, LINES = 0.15, 0.2, 0.25, 0.1, 0.3
LEAST = 0.35
#: Days after which the weight of time has fallen to half; words that a repeated line has at least.
HALF_LIFE, LINE_WORDS = 2.0, 6
#: Rows of an engagement that are held together; rows compared with such a block at a time, and meetings of equal words counted at a time.
BLOCK, ASKED, MET = 1024, 64, 2_000_000


def _words(text: Column, longer: int = 2) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > longer), lambda w: F.hash(w)))


def _nodes(messages: DataFrame) -> DataFrame:
    timed = to_utc(kept_messages(messages.where("delivery_id is not null"), _COLUMNS), "date_raw", "mailbox_tz", True, "at")
    irt = message_key(F.col("in_reply_to"))
    refs = message_keys(F.col("ref_ids"))
    lines = F.filter(F.transform(F.split(F.coalesce("body_text", F.lit("")), r"\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))), lambda x: F.size(F.split(x, " ")) >= LINE_WORDS)
    read = timed.select(
        F.col("delivery_id").alias("id"),
        message_key(F.col("message_id")).alias("key"),
        irt.alias("irt"),
        refs.alias("refs"),
        "at",
        F.coalesce("at", F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(0)).alias("seen"),
        is_blank(F.col("body_text")).alias("blank"),
        F.lower(F.trim(F.col("sender.email"))).alias("email"),
        "engagement_id",
        F.xxhash64(plain_subject(F.col("subject"))).alias("subject"),
        (plain_subject(F.col("subject")) != "").alias("titled"),
        _words(plain_subject(F.col("subject"))).alias("topic"),
        _words(F.col("sender.display_name")).alias("names"),
        _words(F.col("body_text")).alias("words"),
        F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"),
    )
    read = cut(read)
    return read.where("key is not null").unionByName(read.where("key is null").dropDuplicates(["id"]))


def _hints(gap_days: Column, child: str, target: str) -> Column:
    """What speaks for a link besides what is stated: 0 to 1, from the columns of nodes under two prefixes."""
    c, t = lambda x: F.col(f"{child}_{x}"), lambda x: F.col(f"{target}_{x}")
    jaccard = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    time = F.when(gap_days >= 0, F.pow(F.lit(0.5), gap_days / HALF_LIFE)).otherwise(0.0)
    mention = F.arrays_overlap(c("words"), t("names")).cast("double")
    repeated = F.least(F.size(F.array_intersect(c("lines"), t("lines"))), F.lit(2)) / 2
    parts = (TIME, time), (MENTION, mention), (TOPIC, jaccard(c("topic"), t("topic"))), (WORDS, jaccard(c("words"), t("words"))), (LINES, repeated)
    return sum((F.lit(w) * F.coalesce(x, F.lit(0.0)) for w, x in parts), F.lit(0.0))


def _scored(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (child, target, stated) with their score."""
    held = ("seen", "topic", "names", "words", "lines")
    side = lambda p: nodes.select(F.col("id").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in held])
    gap = (F.col("child_seen") - F.col("target_seen")) / 86_400_000_000
    met = links.join(side("child"), "child").join(side("target"), "target")
    return met.select("child", "target", "stated", (F.col("stated") * STATED + _hints(gap, "child", "target")).alias("score"))


def reply_links(nodes: DataFrame) -> DataFrame:
    """(child, target, stated) of each distinct id that a row names; stated is 1 for the one it answers, target null if no kept row bears it."""
    last = F.element_at(F.col("refs"), F.when(F.size("refs") > 0, F.lit(-1)).otherwise(F.lit(None)).cast("int"))
    named = nodes.select(F.col("id").alias("child"), F.coalesce("irt", last).alias("answers"), F.explode(F.array_distinct(F.array_compact(F.concat(F.array("irt"), "refs")))).alias("key"))
    targets = nodes.where("key is not null").select("key", F.col("id").alias("target"))
    return named.join(targets, "key", "left").select("child", "target", (F.col("answers") == F.col("key")).cast("int").alias("stated"))


def likeliest_parents(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(child, parent): the target of the best link of each row, ties to the smallest target; null if that target is missing.

    A row with one link only needs no score, nor does a missing target, whose stated link wins and whose other links lose.
    """
    rank = F.struct("score", (-F.col("target")).alias("t"), F.col("target").alias("parent"))
    choice = links.groupBy("child").agg(F.count("*").alias("n"), F.max(F.struct("stated", "target")).alias("one"))
    alone = choice.where("n = 1 or (one.stated = 1 and one.target is null)").select("child", F.col("one.target").alias("parent"))
    several = links.where("target is not null").join(choice.where("n > 1 and not (one.stated = 1 and one.target is null)").select("child"), "child", "left_semi")
    best = _scored(several, nodes).groupBy("child").agg(F.max(rank).alias("b")).select("child", F.col("b.parent").alias("parent"))
    return alone.unionByName(best)


def _sets(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a column: how many each row has, the row of each value, the values."""
    column = rows[name].combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _only(sets: tuple[np.ndarray, np.ndarray, np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of the rows marked in keep, these numbered anew."""
    sizes, rows, values = sets
    return sizes[keep], (np.cumsum(keep) - 1)[rows[keep[rows]]], values[keep[rows]]


def _common(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b, as a matrix."""
    order = np.argsort(b[2], kind="stable")
    values, rows = b[2][order], b[1][order]
    first = np.searchsorted(values, a[2], "left")
    n = np.searchsorted(values, a[2], "right") - first
    cells = np.zeros(len(a[0]) * len(b[0]), dtype=np.int64)
    met = np.cumsum(n)
    for low in range(0, int(met[-1]) if len(met) else 0, MET):
        at = slice(np.searchsorted(met, low, "right"), np.searchsorted(met, low + MET, "right"))
        k = n[at]
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[at], k)
        cells += np.bincount(np.repeat(a[1][at], k) * len(b[0]) + rows[place], minlength=len(cells))
    return cells.reshape(len(a[0]), len(b[0]))


def _jaccard(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    both = _common(a, b)
    return both / np.maximum(a[0][:, None] + b[0][None, :] - both, 1)


def _best_of_block(asks: pa.Table, posts: pa.Table) -> pa.Table:
    """(child, target, score) of the likeliest of posts for each of asks, where one scores LEAST or more: the hints of _hints, pair by pair.

    Words are counted last, and only for rows with a pair that they could make the best.
    """
    column = lambda rows, name: rows[name].to_numpy()
    of = {x: _sets(posts, x) for x in ("topic", "names", "words", "lines")}
    child, target, score = [], [], []
    for start in range(0, asks.num_rows if posts.num_rows else 0, ASKED):
        some = asks.slice(start, ASKED)
        mine = {x: _sets(some, x) for x in ("topic", "words", "lines")}
        open_ = (column(posts, "n")[None, :] < column(some, "n")[:, None]) & (column(posts, "id")[None, :] != column(some, "id")[:, None])
        gap = np.maximum(column(some, "seen")[:, None] - column(posts, "seen")[None, :], 0) / 86_400_000_000
        early = 0.0 + TIME * np.power(0.5, gap / HALF_LIFE) + MENTION * (_common(mine["words"], of["names"]) > 0) + TOPIC * _jaccard(mine["topic"], of["topic"])
        late = LINES * (np.minimum(_common(mine["lines"], of["lines"]), 2) / 2)
        sure = np.where(open_, early + late, -1.0)
        open_ &= sure + WORDS >= np.maximum(sure.max(axis=1, keepdims=True), LEAST) - 1e-9
        r, c = open_.any(axis=1), open_.any(axis=0)
        if not r.any():
            continue
        cell = np.ix_(r, c)
        total = np.where(open_[cell], early[cell] + WORDS * _jaccard(_only(mine["words"], r), _only(of["words"], c)) + late[cell], -1.0)
        most = total.max(axis=1)
        ids = np.where(total == most[:, None], column(posts, "id")[c][None, :], np.iinfo(np.int64).max).min(axis=1)
        good = most >= LEAST
        child.append(column(some, "id")[r][good])
        target.append(ids[good])
        score.append(most[good])
    joined = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    return pa.table({"child": joined(child, pa.int64()), "target": joined(target, pa.int64()), "score": joined(score, pa.float64())})


def channel_links(nodes: DataFrame, asking: DataFrame) -> DataFrame:
    """(child, target, score): for each id in asking the likeliest row of each block of the earlier rows of its engagement, where one scores LEAST or more.

    Every earlier row is scored, by seen and then id; ties go to the smallest target. An engagement is cut into blocks of BLOCK rows
    by time, and each block of asking rows meets each block no later than it in a task's memory, so a large engagement is spread over
    many tasks. The work grows with the pairs of rows within an engagement, not with those of the table.
    """
    held = ["engagement_id", "seen", "id"]
    nodes = nodes.where("engagement_id is not null")
    placed = spread_row_number(nodes.select(*held).distinct(), ["engagement_id"], [F.col("seen"), F.col("id")], "n")
    placed = cut(placed.select(*held, "n", F.floor((F.col("n") - 1) / BLOCK).cast("int").alias("block")))
    own = placed.join(asking.select("id"), "id", "left_semi").withColumnRenamed("block", "i")
    blocks = own.select("engagement_id", "i").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i"))))
    asks = nodes.select(*held, "topic", "words", "lines").join(own, held).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i"))))
    posts = nodes.select(*held, "topic", "names", "words", "lines").join(placed.withColumnRenamed("block", "j"), held).join(blocks, ["engagement_id", "j"])
    # new names for the same columns, or the two sides can't be told apart
    posts = posts.select(*[F.col(x).alias(x) for x in posts.columns])
    key = ["engagement_id", "i", "j"]
    return asks.groupBy(*key).cogroup(posts.groupBy(*key)).applyInArrow(_best_of_block, "child long, target long, score double")


def inferred_parents(nodes: DataFrame, asking: DataFrame) -> DataFrame:
    """(child, parent): the likeliest of all earlier rows of the engagement for the rows in asking, where one scores LEAST or more; ties to the smallest target."""
    best = F.max(F.struct("score", (-F.col("target")).alias("t"), F.col("target").alias("parent")))
    return channel_links(nodes, asking).groupBy("child").agg(best.alias("b")).select("child", F.col("b.parent").alias("parent"))


def link_trees(starts: DataFrame) -> DataFrame:
    """(id, root, dist, latest) of every row whose chain of parents ends in a root.

    starts: (id, parent, at, is_root). Each round doubles the length of chain that a row
    has looked back over, so depth d takes about log2 d rounds. A round that ends no
    chain leaves only loops. Rows that have reached a root leave the joins, and with them
    the root that many rows share.
    """
    state = cut(starts.select("id", F.when(F.col("is_root"), F.col("id")).otherwise(F.col("parent")).alias("ptr"), F.col("at").alias("latest"), F.when(F.col("is_root"), 0).otherwise(1).cast("long").alias("dist"), F.col("is_root").alias("done")).where("ptr is not null"))
    pending = state.where("not done").count()
    while pending:
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("latest").alias("l2"), F.col("dist").alias("d2"), F.col("done").alias("f2"))
        stepped = (
            state.where("not done")
            .join(ahead, "ptr")
            .select("id", F.col("p2").alias("ptr"), F.greatest("latest", "l2").alias("latest"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("f2").alias("done"))
        )
        state = cut(state.where("done").unionByName(stepped))
        left = state.where("not done").count()
        if left == pending:
            break
        pending = left
    return state.where("done").select("id", F.col("ptr").alias("root"), "dist", "latest")


def disentangled(messages: DataFrame) -> DataFrame:
    """(delivery_id, parent_id, root_id, depth, link) of each kept row: its parent, stated or inferred, and its tree.

    link is `stated`, `inferred`, or `root`; a row whose chain of parents never ends has null root_id and depth. A stated
    link whose target is missing gives way to the likeliest other. Rows without engagement or delivery_id infer nothing.
    """
    nodes = _nodes(messages)
    links = cut(reply_links(nodes))
    stated = cut(likeliest_parents(links.where("target is not null and target <> child"), nodes))
    asking = nodes.select("id").join(stated.select(F.col("child").alias("id")), "id", "left_anti")
    parents = cut(stated.withColumn("link", F.lit("stated")).unionByName(inferred_parents(nodes, asking).withColumn("link", F.lit("inferred"))))
    starts = nodes.select("id", "at").join(parents.withColumnRenamed("child", "id"), "id", "left").withColumn("is_root", F.col("parent").isNull())
    trees = link_trees(starts)
    return starts.select("id", "parent", F.coalesce("link", F.lit("root")).alias("link")).join(trees, "id", "left").select(F.col("id").alias("delivery_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), F.col("dist").alias("depth"), "link")


def sound_conversations(messages: DataFrame, engagements: DataFrame) -> DataFrame:
    """(root_id, turn_no, delivery_id, speaker_role) of each turn of each sound conversation.

    A tree of parents is sound unless one of its rows names, or is named by, a row outside
    it or an id that no kept row bears: whatever lies outside has another root, or none, so the
    whole conversation has not exactly one. Blank ids count as absent, rows without
    delivery_id are ignored, rows without message_id count once for each delivery_id. A body of white space only, no-break
    spaces included, is blank. A row in an engagement that is not listed is neither system nor auditor, but client or unknown.
    """
    nodes = _nodes(messages)
    is_root = F.col("irt").isNull() & (F.size("refs") == 0)
    links = cut(reply_links(nodes))
    parents = likeliest_parents(links, nodes)
    starts = nodes.select("id", "at", is_root.alias("is_root")).join(parents.withColumnRenamed("child", "id"), "id", "left")
    trees = cut(link_trees(starts))

    of = trees.select("id", "root")
    ends = links.join(of.select(F.col("id").alias("child"), F.col("root").alias("a")), "child", "left").join(of.select(F.col("id").alias("target"), F.col("root").alias("b")), "target", "left")
    crossing = ends.where("a is null or b is null or a <> b").select(F.explode(F.array("a", "b")).alias("root")).where("root is not null").distinct()

    client = engagements.groupBy("engagement_id").agg(F.min(F.lower(F.trim("portal_email"))).alias("portal"), F.min(F.lower(F.trim("auditor_domain"))).alias("auditors"))
    role = (
        F.when(F.col("email").isNull(), "unknown")
        .when(F.col("email") == F.col("portal"), "system")
        .when(F.substring_index(F.col("email"), "@", -1) == F.col("auditors"), "auditor")
        .otherwise("client")
    )
    turns = trees.join(nodes.select("id", "blank", "email", "engagement_id"), "id").join(client, "engagement_id", "left").select("root", "id", "dist", "latest", "blank", role.alias("role"))
    sound = (
        turns.groupBy("root")
        .agg(F.count("*").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or(F.col("role") == "auditor").alias("aud"), F.bool_or(F.col("role") == "client").alias("cli"))
        .where("n >= 2 and not blank and aud and cli")
        .select("root")
        .join(crossing, "root", "left_anti")
    )
    kept = turns.join(sound, "root", "left_semi")
    numbered = spread_row_number(kept, ["root"], [F.col("latest").asc_nulls_first(), F.col("dist"), F.col("id")], "turn_no")
    return numbered.select(F.col("root").alias("root_id"), F.col("turn_no").cast("long").alias("turn_no"), F.col("id").alias("delivery_id"), F.col("role").alias("speaker_role"))
