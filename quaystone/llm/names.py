"""Variant spellings of people and organisations (problem 5).

Names are reduced to their parts: titles, roles, legal forms and middle initials go, nicknames and
abbreviations become the full word, order stops to matter. Distinct names meet by a
pigeonhole segment join: each is cut into k+1 segments that stand in an inverted index,
and looked up with the substrings of the others at shifted positions, also with a swap across
two segments; a banded edit distance verifies. Names with an initial only, and initials of organisations, are then
given to the one cluster of full names that fits. Everything is keyed by engagement and segment, so
an engagement that holds a third of all rows spreads over all tasks.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.operators.graph import components
from quaystone.session import cut

#: Edits that the segment join finds.
K = 2
#: Of two spellings of a part, each is a name of its own and no typing error if more than this share of the full names
#: that have it stand in their engagement without the other, with more than one partner, and if it has at least this share of the
#: names of any spelling that it is linked to.
OWN_SHARE, OWN_RATIO = 0.5, 0.2
#: From this many letters on two edits are forgiven, below it one.
LONG = 11

# Titles, professional suffixes, roles that are no person, name particles, legal forms.
_TITLES = set("mr mrs ms miss mx dr prof hr herr frau mme mlle m. sr sra srta ing".split())
_SUFFIXES = re.compile(r"(?i)[,\s]+(?:cpa|cia|cfa|cisa|acca|aca|mba|phd|esq|jr|sr|ii|iii)\.?(?=$|,|\s)")
_FUNCTIONS = set("accounts account payable receivable finance team audit payroll office desk support admin info notices portal treasury tax legal department dept group mailbox billing".split())
_PARTICLES = set("van der den de del della di da la le los las von zu zum al el bin ibn ter ten dos du".split())
_LEGAL = {
    "inc": "inc", "incorporated": "inc", "llc": "llc", "ltd": "ltd", "limited": "ltd", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "gmbh": "gmbh", "sa": "sa", "ag": "ag", "plc": "plc", "llp": "llp", "lp": "lp", "bv": "bv", "nv": "nv", "sarl": "sarl", "srl": "srl", "spa": "spa", "sas": "sas", "kg": "kg", "ab": "ab", "oy": "oy", "as": "as",
}
# Words that say what an organisation does; a shortened form is read as the one it abbreviates.
_TRADES = (
    "logistics technologies laboratories properties holdings shipping materials refrigeration foods services industries distribution manufacturing "
    "international packaging beverages trading partners systems solutions energy capital investments enterprises consulting products resources construction "
    "development management transportation retail wholesale pharmaceuticals automotive chemicals electronics engineering insurance communications"
).split()
# Nicknames and the name each stands for.
_NICKNAMES = """
bob:robert rob:robert bobby:robert robbie:robert bill:william will:william billy:william willy:william liam:william dick:richard rick:richard rich:richard ricky:richard
tom:thomas tommy:thomas jim:james jimmy:james jamie:james joe:joseph joey:joseph jon:jonathan jonny:jonathan johnny:john jack:john mike:michael mick:michael mickey:michael
dan:daniel danny:daniel dave:david davy:david steve:steven matt:matthew matty:matthew andy:andrew drew:andrew tony:anthony ant:anthony chris:christopher topher:christopher kit:christopher
nick:nicholas nicky:nicholas greg:gregory gabe:gabriel sam:samuel sammy:samuel ben:benjamin benny:benjamin benji:benjamin ed:edward eddie:edward ted:edward ned:edward teddy:theodore theo:theodore
charlie:charles chuck:charles chaz:charles harry:henry hank:henry hal:henry larry:lawrence lars:lawrence laurie:lawrence ron:ronald ronnie:ronald ray:raymond fred:frederick freddy:frederick freddie:frederick fritz:frederick
tim:timothy timmy:timothy phil:philip pip:philip vince:vincent vinny:vincent vin:vincent zach:zachary zack:zachary zac:zachary alex:alexander sasha:alexander al:alexander xander:alexander
liz:elizabeth beth:elizabeth lizzie:elizabeth betty:elizabeth eliza:elizabeth betsy:elizabeth libby:elizabeth kate:katherine kathy:katherine katie:katherine kat:katherine kay:katherine kitty:katherine
pat:patricia patty:patricia trish:patricia tricia:patricia pam:pamela jenny:jennifer jen:jennifer jenn:jennifer debbie:deborah deb:deborah debby:deborah sue:susan susie:susan suzy:susan
becky:rebecca becca:rebecca jackie:jacqueline jacqui:jacqueline maggie:margaret meg:margaret peggy:margaret marge:margaret greta:margaret abby:abigail abbie:abigail gail:abigail vicky:victoria vicki:victoria tori:victoria
gwen:gwendolyn wendy:gwendolyn ros:rosalind roz:rosalind tavi:octavia tilly:ottilie immy:imogen quin:quentin pepe:jose chuy:jesus paco:francisco lola:dolores
""".split()
_FORMAL = dict(x.split(":") for x in _NICKNAMES)

_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.casefold().replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def read_person(name: str | None) -> tuple[str, str, str] | None:
    """(kind, a, b): full with two sorted parts, init with an initial and a part, one with a single part; None if nobody is named."""
    if not name or not name.strip():
        return None
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name).strip().strip("'\"“”‘’` ")
    text = _SUFFIXES.sub(" ", " " + text).strip(" ,")
    if " " not in text and re.search(r"[._]", text.rstrip(".")):
        text = re.sub(r"[._]+", " ", text.split("@")[0])
    text = fold(text)
    if "," in text:
        family, _, given = text.partition(",")
        text = given + " " + family
    raw = [t.strip(".") for t in re.sub(r"['’`]", "", text).replace("-", " - ").split()]
    tokens: list[str] = []
    glue = ""
    k = 0
    while k < len(raw):
        t = "".join(_WORD.findall(raw[k]))
        if raw[k] == "-":
            if tokens and not glue:
                glue = tokens.pop()
        elif t:
            nxt = raw[k + 1] if k + 1 < len(raw) else ""
            if (t in _PARTICLES and nxt and nxt != "-") or (nxt in ("der", "la") and len(t) <= 3 and t not in _TITLES):
                glue += t
            else:
                tokens.append(glue + t)
                glue = ""
        k += 1
    if glue:
        tokens.append(glue)
    while len(tokens) > 1 and tokens[0] in _TITLES:
        tokens = tokens[1:]
    # a title may also stand between, as after a reversed name
    tokens = [t for t in tokens if t not in _TITLES or len(tokens) < 3]
    if not tokens or all(t in _FUNCTIONS for t in tokens):
        return None
    long = [t for t in tokens if len(t) > 1]
    if len(long) >= 2:
        parts = [_FORMAL.get(long[0], long[0]), _FORMAL.get(long[-1], long[-1]) if len(long) == 2 else "".join(long[1:])]
        a, b = sorted(parts)
        return "full", a, b
    if len(long) == 1 and len(tokens) > 1:
        return "init", next(t for t in tokens if len(t) == 1), long[0]
    return ("one", long[0], "") if long else None


def _trade(token: str) -> str | None:
    """The trade word that a token is or abbreviates."""
    if token in _TRADES:
        return token
    if len(token) < 2:
        return None
    fits = []
    for t in _TRADES:
        if t[0] == token[0] and len(token) < len(t):
            rest = iter(t)
            if all(c in rest for c in token):
                fits.append(t)
    if len(fits) > 1:
        starts = [t for t in fits if t.startswith(token.rstrip("s"))]
        fits = starts if len(starts) == 1 else fits
    return fits[0] if len(fits) == 1 else None


def _near_trade(token: str) -> bool:
    return len(token) > 4 and any(abs(len(t) - len(token)) < 2 and damerau(t, token, 1) <= 1 for t in _TRADES)


def read_organisation(name: str | None) -> tuple[str, str, str] | None:
    """(kind, a, b): org with its words, trade last, and its legal form; acro with its initials and its legal form."""
    if not name or not name.strip():
        return None
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name).strip().strip("'\"“”‘’` ")
    text = re.sub(r"['’`]", "", fold(text))
    text = re.sub(r"\b((?:[a-z]\.){2,}[a-z]?)", lambda m: m[1].replace(".", "") + " ", text)
    tokens = re.findall(r"[^\W_]+", text)
    if tokens and tokens[0] == "the" and len(tokens) > 1:
        tokens = tokens[1:]
    legal = ""
    while len(tokens) > 1 and tokens[-1] in _LEGAL:
        legal = legal or _LEGAL[tokens.pop()]
        if len(tokens) > 1 and tokens[-1] in _LEGAL:
            continue
        break
    if not tokens:
        return None
    if len(tokens) == 1 and 2 <= len(tokens[0]) <= 4 and re.search(rf"(?i)\b{tokens[0]}\b", name) and tokens[0].upper() in name:
        return "acro", tokens[0], legal
    at = None
    if len(tokens) > 1:
        exact = [k for k in (len(tokens) - 1, 0) if tokens[k] in _TRADES]
        short = [k for k in (len(tokens) - 1, 0) if _trade(tokens[k])]
        near = [k for k in (len(tokens) - 1, 0) if _near_trade(tokens[k])]
        at = (exact or near or short or [None])[0]
    if at is None:
        return "org", " ".join(tokens), legal
    trade = _trade(tokens[at]) if not (at in near and at not in exact) else tokens[at]
    rest = tokens[:at] + tokens[at + 1 :]
    return "org", " ".join([*rest, trade or tokens[at]]), legal


def damerau(a: str, b: str, limit: int) -> int:
    """Banded edit distance in which a swap of neighbours is one edit; limit + 1 if it is more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    before, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        now = [limit + 1] * (m + 1)
        if i <= limit:
            now[0] = i
        for j in range(max(1, i - limit), min(m, i + limit) + 1):
            d = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, now[j - 1] + 1)
            if before is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            now[j] = min(d, limit + 1)
        if min(now) > limit:
            return limit + 1
        before, row = row, now
    return min(row[m], limit + 1)


def _cuts(size: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k+1 even segments of a string."""
    short, longer = divmod(size, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = short + (1 if i >= k + 1 - longer else 0)
        out.append((at, n))
        at += n
    return out


def index_keys(text: str, k: int = K) -> list[str]:
    """Keys under which a string stands in the inverted index; short ones stand under their length too."""
    if len(text) <= k:
        return [f"{len(text)}||"]
    return [f"{len(text)}|{i}|{text[s : s + n]}" for i, (s, n) in enumerate(_cuts(len(text), k))]


def probe_keys(text: str, k: int = K, swaps: bool = False) -> set[str]:
    """Keys that any string within k edits stands under: its segments at positions shifted by what k edits allow.

    With swaps, a swap of neighbours is one edit. Inside a segment it is like any other; across two it is charged to
    the right one, so the segment that no edit is charged to may end with the letter after the next.
    """
    out = set()
    size = len(text)
    for other in range(max(0, size - k), size + k + 1):
        if other <= k:
            out.add(f"{other}||")
            continue
        diff = size - other
        for i, (s, n) in enumerate(_cuts(other, k)):
            # shifts that leave enough edits for the rest, seen from the left and from the right
            lo = max(0, s - i, s + diff - (k - i))
            hi = min(size - n, s + i, s + diff + (k - i))
            for p in range(lo, hi + 1):
                out.add(f"{other}|{i}|{text[p : p + n]}")
                if swaps and i < k and p + n < size:
                    out.add(f"{other}|{i}|{text[p : p + n - 1]}{text[p + n]}")
    return out


def segment_join(index: DataFrame, probe: DataFrame, carry: list[str], k: int = K, swaps: bool = False) -> DataFrame:
    """Pairs of an index and a probe row with one scope whose texts are within k edits: (l_x, r_x for x in carry).

    index and probe hold scope, text and the carried columns. With swaps, all pairs within k edits of which a swap of
    neighbours is one, and some others: s swaps and e other edits make at most 2 s + e plain ones and change e letters.
    """

    def keyed(df: DataFrame, make) -> DataFrame:
        # only the text goes to Python: a bigint that may be null would come back as a rounded float
        @F.pandas_udf("array<string>")
        def keys(texts: pd.Series) -> pd.Series:
            return pd.Series([sorted(make(t)) for t in texts], dtype=object)

        return df.withColumn("key", F.explode(keys("text")))

    # a probe yields some twenty keys, so even what lies in one small file is spread before it is multiplied
    tasks = index.sparkSession.sparkContext.defaultParallelism
    index, probe = (df.select("scope", "text", *carry).repartition(tasks, "text") for df in (index, probe))
    left, right = keyed(index, lambda t: index_keys(t, k)), keyed(probe, lambda t: probe_keys(t, k, swaps))
    left = left.select(F.xxhash64("scope", "key").alias("h"), F.col("scope").alias("l_scope"), F.col("text").alias("l_text"), *[F.col(c).alias(f"l_{c}") for c in carry])
    right = right.select(F.xxhash64("scope", "key").alias("h"), F.col("scope").alias("r_scope"), F.col("text").alias("r_text"), *[F.col(c).alias(f"r_{c}") for c in carry])
    within = F.levenshtein("l_text", "r_text", k) >= 0
    if swaps:
        plain = F.levenshtein("l_text", "r_text", 2 * k)
        letters = [F.array_join(F.array_sort(F.split(c, "")), "") for c in ("l_text", "r_text")]
        within = within | ((plain > k) & (F.levenshtein(*letters) <= 2 * (2 * k - plain)))
    near = (F.col("l_scope") == F.col("r_scope")) & (F.col("l_node") != F.col("r_node")) & within
    return left.join(right, "h").where(near).drop("h").distinct()


def _parsed(rows: DataFrame, table: str) -> DataFrame:
    """(src_table, id, eng, kind, a, b, email) of each row that names somebody."""
    read = read_person if table == "addresses" else read_organisation

    @F.pandas_udf("kind string, a string, b string")
    def parse(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x) or (None, None, None) for x in names], columns=["kind", "a", "b"], dtype=object)

    return rows.select(F.lit(table).alias("src_table"), "id", "eng", "email", parse("name").alias("p")).select("src_table", "id", "eng", "email", "p.*").where("kind is not null")


def linked_rows(addresses: DataFrame, entities: DataFrame) -> DataFrame:
    """(src_table, id, label): rows of one table and engagement with one label mean the same.

    Rows with null or blank names, or whose name is that of a shared mailbox, are absent;
    a row with null engagement_id has a label of its own. A name with an initial
    that fits several clusters goes to the one that its email names, else it stays with its like: the same spelling
    and mailbox, or spellings within one edit with one mailbox.
    """
    people = _parsed(addresses.select(F.col("addr_id").cast("long").alias("id"), F.col("engagement_id").alias("eng"), F.lower("email").alias("email"), F.col("display_name").alias("name")), "addresses")
    firms = _parsed(entities.select(F.col("entity_id").cast("long").alias("id"), F.col("engagement_id").alias("eng"), F.lit(None).cast("string").alias("email"), F.col("entity_name").alias("name")), "entities")
    local = F.regexp_replace(F.regexp_replace(F.substring_index(F.col("email"), "@", 1), r"\+.*", ""), r"[^a-z.]", "")
    rows = people.unionByName(firms).withColumn("local", F.when(F.col("kind") == "init", F.coalesce(local, F.lit(""))).otherwise(""))
    legal = F.when(F.col("kind") == "org", "").otherwise(F.col("b"))
    alike = F.xxhash64("src_table", "eng", "kind", "a", legal, "local")
    rows = cut(rows.withColumn("node", F.when(F.col("eng").isNull(), F.xxhash64("src_table", "id", F.lit("no engagement"))).otherwise(alike)))
    loose = rows.where("eng is null").select("src_table", "id", "eng", F.col("node").alias("label"))
    rows = rows.where("eng is not null")

    weak = F.col("kind").isin("init", "acro")
    strong = rows.where(~weak).groupBy("node").agg(*[F.first(c).alias(c) for c in ("src_table", "eng", "kind", "a")], F.max("b").alias("b"), F.count("*").alias("n"))
    strong = cut(strong.withColumn("scope", F.concat_ws("/", "src_table", "eng", "kind")))
    orders = F.when(F.col("kind") == "full", F.array(F.concat("a", "b"), F.concat("b", "a"))).otherwise(F.array("a"))
    carry = ["node", "kind", "a", "b"]
    shown = strong.withColumn("text", F.explode(orders))
    first = strong.withColumn("text", F.element_at(orders, 1))
    pairs = segment_join(shown, first, carry, swaps=True).select("l_node", "r_node", "l_kind", "l_a", "l_b", "r_a", "r_b").where("l_node < r_node").distinct()

    @F.pandas_udf("ok boolean, differ array<struct<t: string, u: string>>")
    def verify(kind: pd.Series, la: pd.Series, lb: pd.Series, ra: pd.Series, rb: pd.Series) -> pd.DataFrame:
        out = []
        for k, a, b, c, d in zip(kind, la, lb, ra, rb):
            if k != "full":
                out.append((damerau(a, c, 2) <= (2 if min(len(a), len(c)) >= LONG else 1), []))
                continue
            best = (9, [])
            for x, y in ((c, d), (d, c)):
                p, q = damerau(a, x, 2), damerau(b, y, 2)
                if p + q < best[0]:
                    best = (p + q, [{"t": i, "u": j} for i, j, n in ((a, x, p), (b, y, q)) if n])
            out.append((best[0] <= (2 if min(len(a + b), len(c + d)) >= LONG else 1), best[1]))
        return pd.DataFrame(out, columns=["ok", "differ"])

    verified = cut(pairs.withColumn("v", verify("l_kind", "l_a", "l_b", "r_a", "r_b")).where("v.ok").select("l_node", "r_node", "v.differ"))
    # distinct full names of an engagement are counted, not rows: copies of a typing error prove nothing
    bearers = strong.where("kind = 'full'").select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("p")), F.struct(F.col("b").alias("w"), F.col("a").alias("p")))).alias("s")).select("s.*")
    parts = bearers.groupBy("w").agg(F.count("*").alias("n"), F.countDistinct("p").alias("partners"))
    differing = verified.select("l_node", "r_node", F.explode("differ").alias("w")).select("l_node", "r_node", "w.*")
    sided = differing.select(F.col("l_node").alias("node"), F.col("t").alias("w"), F.col("u").alias("other")).unionByName(differing.select(F.col("r_node").alias("node"), F.col("u").alias("w"), F.col("t").alias("other")))
    met = sided.distinct().groupBy("w", "other").agg(F.count("*").alias("met"))
    stood = met.join(parts, "w").join(parts.select(F.col("w").alias("other"), F.col("n").alias("n_other")), "other")
    top = stood.groupBy("w").agg(F.max("n_other").alias("most"))
    stood = stood.join(top, "w").where((F.col("n") - F.col("met") > OWN_SHARE * F.col("n")) & (F.col("partners") > 1) & (F.col("n") >= OWN_RATIO * F.col("most"))).select("w", "other")
    own_pairs = stood.select(F.col("w").alias("t"), F.col("other").alias("u")).join(stood.select(F.col("other").alias("t"), F.col("w").alias("u")), ["t", "u"])
    own_names = differing.join(own_pairs, ["t", "u"], "left_semi").select("l_node", "r_node").distinct()
    links = verified.select("l_node", "r_node").join(own_names, ["l_node", "r_node"], "left_anti").select(F.col("l_node").alias("x"), F.col("r_node").alias("y"))
    labels = components(strong.select("node"), links)
    clusters = cut(strong.join(labels, "node"))

    # names with an initial: the other part within one edit, the initial fits
    initial = rows.where(F.col("kind") == "init").groupBy("node").agg(*[F.first(c).alias(c) for c in ("src_table", "eng", "a", "b", "local")])
    initial = cut(initial.select("node", F.concat_ws("/", "src_table", "eng", "a").alias("scope"), F.col("b").alias("text"), "local", F.lit(None).cast("long").alias("label"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("given")))
    side = lambda g, f: clusters.where("kind = 'full'").select("node", F.concat_ws("/", "src_table", "eng", F.substring(g, 1, 1)).alias("scope"), F.col(f).alias("text"), F.lit("").alias("local"), "label", "n", F.col(g).alias("given"))
    held = side("a", "b").unionByName(side("b", "a")).unionByName(initial)

    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([damerau(a, b, 1) for a, b in zip(x, y)], dtype="int32")

    fits = segment_join(held, initial, ["node", "local", "label", "n", "given"]).withColumn("d", apart("l_text", "r_text")).where("d <= 1")
    fits = cut(fits.select("l_node", "l_label", "l_local", "l_given", "r_node", "r_local", "d"))
    named = F.when(F.length("l_given") > 2, F.col("r_local").contains(F.col("l_given"))).otherwise(F.lit(False))
    options = fits.where("l_label is not null").groupBy("r_node", "l_label").agg(F.min("d").alias("d"), F.max(named).alias("named"))
    best = options.groupBy("r_node").agg(F.min(F.struct((~F.col("named")).alias("a"), F.col("d"))).alias("b"))
    chosen = options.join(best, "r_node").where(F.struct((~F.col("named")).alias("a"), F.col("d")) == F.col("b")).groupBy("r_node").agg(F.count("*").alias("k"), F.min("l_label").alias("label"))
    given = chosen.where("k = 1").select(F.col("r_node").alias("node"), "label")
    # what fits no cluster joins its like; what fits several does so only if the mailbox is the same
    unsure = initial.select("node").join(given.select("node"), "node", "left_anti").join(chosen.select(F.col("r_node").alias("node"), "k"), "node", "left").select("node", F.col("k").isNotNull().alias("doubtful"))
    unsure = cut(unsure)
    end = lambda c: unsure.select(F.col("node").alias(c), F.col("doubtful").alias(f"{c}_doubtful"))
    peers = fits.where("l_label is null").select(F.col("l_node").alias("x"), F.col("r_node").alias("y"), ((F.col("l_local") == F.col("r_local")) & (F.col("l_local") != "")).alias("mailbox"))
    peers = peers.join(end("x"), "x").join(end("y"), "y").where("not x_doubtful and not y_doubtful or x_doubtful and y_doubtful and mailbox").select("x", "y")
    lone = components(unsure.select("node"), peers)

    # initials of organisations: one cluster whose words begin so, of the same legal form if both state one
    words = F.split("a", " ")
    heads = F.transform(words, lambda w: F.substring(w, 1, 1))
    firm = clusters.where("kind = 'org'").select("src_table", "eng", "label", "b", F.explode(F.array_distinct(F.array(F.array_join(heads, ""), F.concat(F.element_at(heads, 1), F.element_at(heads, -1))))).alias("a"))
    acro = rows.where(F.col("kind") == "acro").groupBy("node").agg(*[F.first(c).alias(c) for c in ("src_table", "eng", "a", "b")])
    same = F.when((F.col("f.b") != "") & (F.col("i.b") != ""), (F.col("f.b") == F.col("i.b")).cast("int"))
    met = acro.alias("i").join(firm.alias("f"), (F.col("i.src_table") == F.col("f.src_table")) & (F.col("i.eng") == F.col("f.eng")) & (F.col("i.a") == F.col("f.a")))
    met = met.groupBy(F.col("i.node").alias("node"), F.col("f.label").alias("label")).agg(F.max(same).alias("same")).where("same is null or same = 1")
    top = met.groupBy("node").agg(F.max(F.coalesce("same", F.lit(0))).alias("s"))
    owned = met.join(top, "node").where("coalesce(same, 0) = s").groupBy("node").agg(F.count("*").alias("k"), F.min("label").alias("label")).where("k = 1").select("node", "label")
    spare = acro.select("node").join(owned, "node", "left_anti").select("node", F.col("node").alias("label"))

    all_labels = clusters.select("node", "label").unionByName(given).unionByName(lone).unionByName(owned).unionByName(spare)
    return rows.select("src_table", "id", "eng", "node").join(all_labels, "node").select("src_table", "id", "eng", "label").unionByName(loose)


def same_name_pairs(addresses: DataFrame, entities: DataFrame) -> DataFrame:
    """(src_table, id_a, id_b), id_a < id_b, of every two rows of a class; a row twice in its table counts once."""
    rows = cut(linked_rows(addresses, entities).distinct())
    a = rows.select("src_table", "label", F.col("id").alias("id_a"))
    b = rows.select("src_table", "label", F.col("id").alias("id_b"))
    return a.join(b, ["src_table", "label"]).where("id_a < id_b").select("src_table", "id_a", "id_b").distinct()


def same_name_classes(addresses: DataFrame, entities: DataFrame) -> DataFrame:
    """(src_table, id, class_id, n_links): each named row with the smallest id of its class and the number of other rows in it."""
    rows = linked_rows(addresses, entities).select("src_table", "id", "label").distinct()
    size = rows.groupBy("src_table", "label").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("n_links"))
    return rows.join(size, ["src_table", "label"]).select("src_table", "id", "class_id", "n_links")
