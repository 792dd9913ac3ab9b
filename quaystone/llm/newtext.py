"""The lines of a mail that its sender newly wrote (problem 2).

A first pass reads each body where it lies: quoted lines, introductions, pasted headers,
signatures, notices and footers go by their form. Threads are then rebuilt from the reference headers: a row's ancestors
are the ids it names and all that those name in turn. What is left of a body is aligned with each ancestor by rolling hashes of
five words: a paragraph most of whose hashes lie in an ancestor, as common subsequences, is inherited, and so is
a line within another paragraph that an ancestor has word by word. Only hashes are shuffled, never bodies.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.mailids import message_key, message_keys
from quaystone.session import cut

SHINGLE = 5
#: Share of a paragraph's hashes that an ancestor must hold, in common subsequences of at least two.
LEAST_SHARE = 0.8
#: Words of a line that is inherited though the rest of its paragraph is new.
LEAST_LINE = 12

# Closing formulas, openings of notices and footers, words of job titles.
_CLOSINGS = (
    "best", "best regards", "kind regards", "kindest regards", "regards", "warm regards", "rgds", "brgds", "thanks", "many thanks", "thank you",
    "thanks and regards", "thanks in advance", "cheers", "sincerely", "yours sincerely", "yours faithfully", "yours truly", "respectfully",
    "mit freundlichen grüßen", "freundliche grüße", "viele grüße", "beste grüße", "mfg", "vg",
    "cordialement", "bien cordialement", "bien à vous", "salutations", "merci", "merci d'avance",
    "un saludo", "saludos", "saludos cordiales", "atentamente", "gracias", "muchas gracias",
)
_NOTICES = (
    "confidentiality notice", "this message and any", "this e-mail and any", "this email and any", "the firm accepts no", "any tax advice contained",
    "please consider the environment", "diese e-mail enthält", "ce message est confidentiel", "este mensaje va dirigido", "if you are not the intended",
    "[external]", "caution:", "[list footer]", "you receive this because", "manage notices in the portal", "warning: external", "[caution]",
)
_NOTICE_HEADS = tuple(sorted({n[:4] for n in _NOTICES}))
_MOBILE = re.compile(r"(?i)(sent from (my|a|an) |get outlook for |envoyé de(puis)? mon |enviado desde mi |von meinem \w+ gesendet|gesendet von meinem )")
_TITLE = re.compile(r"(?i)\b(manager|controller|partner|senior|associate|director|cfo|ceo|coo|lead|analyst|coordinator|accountant|treasurer|clerk|officer|counsel|head of|bookkeeper)\b")
_CONTACT = re.compile(r"(?i)^(?:(?:t|m|e|tel|tel\.|phone|mobile|fax|e-mail|email)\b[.:]?\s*)?[+(\d][\d\s().+-]{6,}(?:ext\.? ?\d+)?$|^(?:e:\s*|e-mail:\s*|email:\s*|mailto:)?[\w.+-]+@[\w.-]+$|^\[cid:[^\]]*\]\.?$")
_QUOTE = re.compile(r"\s*(?:>|\||::|[A-ZÀ-ÖØ-ÞŁ]{1,4}>)\s?")
_INTRO = re.compile(r"^\s*(?:On|Am|Le|El|Em|Il)\b.{0,12}\d.*(?:wrote|schrieb\b.*|écrit|escribió|escreveu|scritto)\s*:\s*$")
_INTRO_DATED = re.compile(r"^\s*\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4},? (?:\d\d?[:h]\d\d,? )?[^:]{2,70}:\s*$")
_INTRO_START = re.compile(r"^\s*(?:On|Am|Le|El)\b.{0,12}\d.*\d[:h]\d\d")
_INTRO_END = re.compile(r"(?:wrote|schrieb\b.*|écrit|escribió)\s*:\s*$")
_BREAK = re.compile(r"(?i)^\s*-{2,}\s*(?:original message|forwarded message|mensaje original|mensaje reenviado|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|begin forwarded message)\s*-*\s*$|^\s*_{20,}\s*$")
_HEADER = re.compile(r"^\s*\*?(?:From|Von|De|Da)\s?:\*?\s+.*(?:@|<)")
_HEADER_MORE = re.compile(r"^\s*\*?(?:Sent|Date|To|Subject|Gesendet|Datum|An|Betreff|Envoyé|À|Objet|Enviado|Fecha|Para|Asunto|Cc)\s?:")
_DELIMITER = re.compile(r"^\s*(?:--|-{3,}|_{5,}|={3,}|\*(?: ?\*){2,}|~{3,})\s*$")
_BANNER = re.compile(r"(?i)^\s*(?:\*{3}.*\*{3}|--+ ?(?:scanned|checked|virus)\b.* ?--+|=+ .*external.* =+)\s*$")
_WORD = re.compile(r"[^\W_]+")


def _fold(text: str) -> str:
    text = text.casefold().replace("ø", "o").replace("ł", "l").replace("ß", "ss")
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


_SALUTATION = re.compile(r"(?i)^(?:(?:dear|hello|hi|hey|good (?:morning|afternoon|evening)|bonjour|cher|chère|hola|estimad[oa]s?|buenos días|buenas tardes|liebe[r/]*|sehr geehrte|guten (?:tag|morgen)|hallo|team)\b[^.?!]{0,50}|[A-ZÀ-ÖØ-ÞŁ][\w'’-]+ -)[,:-]?$")


def is_salutation(line: str) -> bool:
    return len(line) < 60 and _SALUTATION.match(line) is not None


class Sender:
    """What is known of a sender's name, to tell the name under a mail from other words."""

    def __init__(self, display: str | None, email: str | None):
        self.tokens = set(_WORD.findall(_fold(display or "")))
        self.local = re.sub(r"[^a-z]", "", _fold((email or "").split("@")[0]))

    def is_name(self, line: str) -> bool:
        if len(line) > 48 or line[-1:] in ".,;:?!" or any(c.isdigit() for c in line):
            return False
        words = _WORD.findall(_fold(line))
        if not 1 <= len(words) <= 6:
            return False
        hits = sum(w in self.tokens or (len(w) > 3 and w in self.local) for w in words)
        joined = "".join(words[1:])
        if len(words) > 1 and joined and joined in self.local:
            return True
        return hits * 2 > len(words) or hits == len(words)


def _capitalised(line: str) -> bool:
    words = line.split()
    return 2 <= len(words) <= 5 and all(w[0].isupper() or w in ("van", "der", "de", "la", "von", "al", "del", "di") or w.startswith("al-") for w in words) and not any(c.isdigit() or c in ".,:;?!()@|/" for c in line)


def own_lines(body: str, display: str | None, email: str | None) -> tuple[list[int], list[bool], int, bool]:
    """Numbers of the lines that look newly written; for every line whether it is neither blank, quoted nor pasted history; the line
    in which a second letter begins, or -1, and whether the sender's own name stands below it, so that it may be to a second person."""
    lines = [x.rstrip() for x in body.split("\n")]
    n = len(lines)
    plain = [False] * n
    quoted = [False] * n
    for i, x in enumerate(lines):
        if x and not x.isspace():
            c = x.lstrip()[0]
            if c in ">|:" or ">" in x[:8]:
                quoted[i] = _QUOTE.match(x) is not None
            plain[i] = not quoted[i]
    own: list[int] = []
    past: list[int] = []
    sender = None
    turn, signed = -1, False
    mode = "new"  # new, sign, notice or past
    intro = False
    i = 0
    while i < n:
        x = lines[i]
        if not plain[i] and not quoted[i]:
            if mode == "notice":
                mode = "new"
            i += 1
            continue
        if quoted[i]:
            alone = (i == 0 or not quoted[i - 1]) and (i + 1 >= n or not quoted[i + 1])
            if mode == "new" and alone and i and plain[i - 1] and not intro and own and own[-1] == i - 1 and x.startswith("> "):
                own.append(i)
            elif mode != "past":
                mode = "new"
            intro = False
            i += 1
            continue
        s = x.strip()
        intro_lines = 0
        if _INTRO.match(x) or _INTRO_DATED.match(x):
            intro_lines = 1
        elif _INTRO_START.match(x):
            for k in (1, 2):
                if i + k < n and plain[i + k] and _INTRO_END.search(lines[i + k]):
                    intro_lines = k + 1
                    break
                if i + k >= n or not plain[i + k]:
                    break
        if intro_lines:
            i += intro_lines
            intro = True
            ahead = next((k for k in range(i, n) if plain[k] or quoted[k]), None)
            if ahead is not None and plain[ahead]:
                mode = "past"
            elif mode != "past":
                mode = "new"
            continue
        if mode == "past":
            past.append(i)
            i += 1
            continue
        if _BREAK.match(x) or (_HEADER.match(x) and any(_HEADER_MORE.match(y) for y in lines[i + 1 : i + 5])):
            mode = "past"
            i += 1
            continue
        low = s.lower()
        if low[:4] in _NOTICE_HEADS and low.startswith(_NOTICES):
            mode = "notice" if mode != "sign" else "sign"
            i += 1
            continue
        if turn >= 0 and mode == "sign" and len(s) < 50:
            sender = sender or Sender(display, email)
            signed = signed or sender.is_name(s)
        if mode in ("sign", "notice") or _BANNER.match(x) or _MOBILE.match(s):
            i += 1
            continue
        if _DELIMITER.match(x) or low.rstrip(",.! ") in _CLOSINGS:
            mode = "sign"
            i += 1
            continue
        if is_salutation(s):
            if turn < 0 and any(not is_salutation(lines[k].strip()) for k in own):
                turn = i
        elif len(s) < 50:
            if sender is None:
                sender = Sender(display, email)
            later = lines[i + 1].strip() if i + 1 < n and plain[i + 1] else ""
            ends = not later or quoted[i + 1]
            card = bool(later) and (_TITLE.search(later) is not None and len(later) < 90 or _CONTACT.match(later) is not None)
            apart = i > 0 and not plain[i - 1] and not quoted[i - 1] and bool(own)
            alone = apart and ends and (_capitalised(s) or s.isalpha() and s[0].isupper())
            if sender.is_name(s) and (ends or card or " " in s) or card and _capitalised(s) or alone:
                mode = "sign"
                signed = signed or turn >= 0 and sender.is_name(s)
                i += 1
                continue
        own.append(i)
        i += 1
    for k in past:
        plain[k] = False
    return own, plain, turn, signed


def _shingles(words: list[str]) -> np.ndarray:
    """The rolling hash of each run of words, never 0."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.int32)
    w = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - SHINGLE + 1 + k]
        h ^= h >> np.uint64(32)
    return (h.astype(np.uint32) | np.uint32(1)).view(np.int32)


_SCAN = "own array<int>, starts array<boolean>, sizes array<int>, hash array<int>, whole array<int>, turn int, signed boolean"


def _scan(frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    for body, display, email, follows in zip(frame["body"], frame["display"], frame["email"], frame["follows"]):
        if not body:
            out.append(([], [], [], [], [], -1, False))
            continue
        own, plain, turn, signed = own_lines(body, display, email)
        lines = body.split("\n")
        whole: list[str] = []
        of: list[int] = []
        for i, p in enumerate(plain):
            if p:
                w = _WORD.findall(lines[i])
                whole += w
                of += [i] * len(w)
        s = _shingles(whole)
        sizes, hashes = [], []
        starts = [k == 0 or own[k] != own[k - 1] + 1 or own[k] == turn or is_salutation(lines[own[k] - 1].strip()) for k in range(len(own))]
        if follows and own:
            para = dict(zip(own, np.cumsum(starts).tolist()))
            of_para = np.array([para.get(i, 0) for i in of], np.int64)
            runs = np.zeros(len(of), np.int32)
            if len(s):
                inside = (of_para[: len(s)] == of_para[SHINGLE - 1 :]) & (of_para[: len(s)] > 0)  # such runs lie in one paragraph
                runs[: len(s)][inside] = s[inside]
            mine = of_para > 0
            counts = np.bincount(np.array(of, np.int64), minlength=len(lines)) if of else np.zeros(len(lines), np.int64)
            sizes, hashes = counts[own].tolist(), runs[mine].tolist()
        out.append((own, starts, sizes, hashes, s.tolist(), turn, signed))
    return pd.DataFrame(out, columns=["own", "starts", "sizes", "hash", "whole", "turn", "signed"])


def _chain(runs: list[int], places: list[list[int]]) -> list[int]:
    """The runs of a longest common subsequence: rising in the text and, with one of their places each, in the ancestor."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[tuple[int, int]] = []  # (run, entry before it)
    for run, at in zip(runs, places):
        for place in reversed(at):  # falling, so a run takes part once
            k = bisect_left(tails, place)
            back.append((run, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(place)
                ends.append(len(back) - 1)
            else:
                tails[k], ends[k] = place, len(back) - 1
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        run, k = back[k]
        out.append(run)
    return out[::-1]


def inherited_lines(own: list[int], starts: list[bool], at: np.ndarray, hashes: np.ndarray, whole: np.ndarray, looped: bool = False) -> list[int]:
    """Those of the own lines that an ancestor, given by its hashes in order, already had.

    at, hashes: line of each own word and hash of the run that starts there, 0 if it leaves its paragraph. A paragraph of two
    runs or more is inherited if LEAST_SHARE of them lie in the ancestor, in common subsequences of two or more, so passages
    may have changed places. A salutation right above it, and what has too few words to tell below it, goes with it. Of other
    paragraphs a line of LEAST_LINE words goes if they all lie in such a subsequence. Of two rows in a loop, each above the other, the
    one that opens with the common text wrote it, so it keeps it.
    """
    place: dict[int, list[int]] = {}
    for k, h in enumerate(whole.tolist()):
        place.setdefault(h, []).append(k)
    para = np.cumsum(starts) - 1
    line_para = dict(zip(own, para.tolist()))
    n = int(para[-1]) + 1 if len(own) else 0
    mine: list[list[int]] = [[] for _ in range(n)]
    total = [0] * n
    lines, runs = at.tolist(), hashes.tolist()
    for k, (line, h) in enumerate(zip(lines, runs)):
        if h:
            p = line_para[line]
            total[p] += 1
            if h in place:
                mine[p].append(k)
    state, alone = [], set()
    for p in range(n):
        left, met = mine[p], []
        while len(left) > 1:
            chain = _chain(left, [place[runs[k]] for k in left])
            if len(chain) < 2:
                break
            met += chain
            used = set(chain)
            left = [k for k in left if k not in used]
        if total[p] < 2:
            state.append(-1)
        elif len(met) >= LEAST_SHARE * total[p]:
            state.append(1)
        else:
            state.append(0)
            if met:
                covered = {k + j for k in met for j in range(SHINGLE)}
                words: dict[int, list[int]] = {}
                for k, line in enumerate(lines):
                    if line_para[line] == p:
                        words.setdefault(line, []).append(k)
                alone |= {line for line, ks in words.items() if len(ks) >= LEAST_LINE and covered.issuperset(ks)}
    if looped and next((x for x in state if x >= 0), 1) == 1:
        return []
    lost = [s == 1 for s in state]
    if any(lost):
        for p in range(n):
            if state[p] == -1 and p > 0 and lost[p - 1]:
                lost[p] = True
        for p in range(n - 2, -1, -1):
            if state[p] == -1 and lost[p + 1] and p > 0:
                lost[p] = True
    return [line for line, p in line_para.items() if lost[p] or line in alone]


def ancestors(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_node, _above) of every row and every id that it names, or that those name in turn, itself left out; and which of them no row states.

    named: (_node, _above) as the rows state them. Only what a round finds anew is followed in the next, so threads whose
    rows list all their references end after one, and loops end too.
    """
    stated = cut(named.where("_node <> _above").distinct())
    known, fresh, found = stated, stated, None
    while True:
        step = fresh.join(stated.select(F.col("_node").alias("_above"), F.col("_above").alias("_next")), "_above").select("_node", F.col("_next").alias("_above")).where("_node <> _above").distinct()
        fresh = cut(step.join(known, ["_node", "_above"], "left_anti"))
        if fresh.isEmpty():
            return known, fresh if found is None else found
        found = fresh if found is None else cut(found.unionByName(fresh))
        known = stated.unionByName(found)


def new_lines(messages: DataFrame) -> DataFrame:
    """(delivery_id, line_no) of each newly written line of each row, lines counted from 0 between line feeds.

    A null or blank body has none. A row whose ancestors are not in the table, or that
    names none, is judged by form alone: a second letter in its body is then taken for pasted history. Where all the ids that a
    row names are there and the sender's name stands below, a second letter goes only if an ancestor has a paragraph of it. Several rows with one message_id are one ancestor.
    """
    udf = _scan_udf()
    own_key = message_key(F.col("message_id"))
    refs = F.array_distinct(F.concat(F.array_compact(F.array(message_key(F.col("in_reply_to")))), message_keys(F.col("ref_ids"))))
    refs = F.filter(refs, lambda k: ~k.eqNullSafe(own_key))
    read = messages.select(
        F.col("delivery_id").cast("long").alias("delivery_id"),
        F.xxhash64(own_key).alias("_key"),
        own_key.isNotNull().alias("_named"),
        F.transform(refs, lambda k: F.xxhash64(k)).alias("_refs"),
        F.struct(F.col("body_text").alias("body"), F.col("sender.display_name").alias("display"), F.col("sender.email").alias("email"), (F.size(refs) > 0).alias("follows")).alias("_in"),
    )
    # a row without an id is a node of its own, which nobody names
    node = F.when(F.col("_named"), F.col("_key")).otherwise(F.xxhash64(F.lit("no id"), F.col("delivery_id"))).alias("_node")
    scanned = cut(read.select("delivery_id", "_named", node, "_refs", udf("_in").alias("s")).select("delivery_id", "_named", "_node", "_refs", "s.*"))

    above, unstated = ancestors(scanned.select("_node", F.explode("_refs").alias("_above")))
    # rows that are above each other, by the one that is compared with
    loops = above.join(above.select(F.col("_above").alias("_node"), F.col("_node").alias("_above")), ["_node", "_above"], "left_semi").groupBy("_above").agg(F.collect_set("_node").alias("loops"))
    held = scanned.where("_named and size(whole) > 0").groupBy(F.col("_node").alias("_above")).agg(F.max("whole").alias("whole")).join(loops, "_above", "left")
    children = scanned.where("size(hash) > 0").select("delivery_id", "_node", "_refs", "own", "starts", "sizes", "hash")
    direct = children.withColumn("_above", F.explode("_refs")).drop("_refs")
    further = children.drop("_refs").join(unstated, "_node")
    pairs = direct.unionByName(further).where("_node <> _above").join(held, "_above").where(F.arrays_overlap("hash", "whole"))
    pairs = pairs.select("delivery_id", "own", "starts", "sizes", "hash", "whole", F.coalesce(F.array_contains("loops", F.col("_node")), F.lit(False)).alias("looped"))

    def compare(parts):
        for p in parts:
            who, lines = [], []
            for key, own, starts, sizes, h, whole, looped in zip(p["delivery_id"], p["own"], p["starts"], p["sizes"], p["hash"], p["whole"], p["looped"]):
                gone = inherited_lines(own.tolist(), starts.tolist(), np.repeat(own, sizes), h, whole, looped)
                who += [key] * len(gone)
                lines += gone
            yield pd.DataFrame({"delivery_id": np.array(who, np.int64), "line_no": np.array(lines, np.int64)})

    gone = cut(pairs.mapInPandas(compare, "delivery_id bigint, line_no bigint").distinct())
    # second letters: by comparison where the sender signs below and all ancestors that the row names are there, else by their form
    twice = scanned.where("turn >= 0").select("delivery_id", "turn", "_refs", "signed")
    missing = twice.select("delivery_id", F.explode_outer("_refs").alias("_key")).join(scanned.where("_named").select(F.col("_node").alias("_key")).distinct(), "_key", "left_anti").select("delivery_id")
    found = twice.join(gone, "delivery_id").where("line_no >= turn").select("delivery_id")
    pasted = twice.join(missing.unionByName(found).unionByName(twice.where("not signed").select("delivery_id")).distinct(), "delivery_id").select("delivery_id", "turn")
    written = scanned.select("delivery_id", F.explode("own").alias("line_no")).select("delivery_id", F.col("line_no").cast("long").alias("line_no"))
    written = written.join(pasted, "delivery_id", "left").where("turn is null or line_no < turn").drop("turn")
    return written.join(gone, ["delivery_id", "line_no"], "left_anti").distinct()


def _scan_udf():
    @F.pandas_udf(_SCAN)
    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        return _scan(frame)

    return scan
