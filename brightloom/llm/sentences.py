"""Problem 9: sentence units of documents in any of many languages and scripts.

Characters are tagged as the start of a sentence or as inside one: those after a gap that marks, blanks or line ends
make, and in unpunctuated text of a script without blanks every character. All others are inside. The tags of a document
are decoded together by Viterbi over a linear chain, whose weights are an averaged structured perceptron's, trained here
on a bounded sample of documents. Their tags come from where punctuation, layout and case are plain; texts of scripts
without blanks are added once more with their marks taken out, where the tags are the places the end marks had. What the
model weighs are parts of what is seen at a place, none of which tells the tag alone. Which words are abbreviations is
counted over all documents. Decoding runs inside the tasks, document by document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.runtime import cut

# Marks, and abbreviations of the languages in scope (lower case, without their last point).
MARKS = ".!?…。！？｡।॥؟۔"
CLOSERS = "\"'”’»›」』）)\\]】》〉｣］"
OPENERS = "\"'“‘«‹「『（(\\[【《〈„‚¿¡｢［"
EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿️‍"
TITLES = set(
    "dr mr mrs ms prof st rev hon gen col capt lt sgt m mm mme mlle dra sr sra srta d dña ing lic hr fr herr frau "
    "dipl г-н г-жа проф акад डॉ श्री प्रो د أ م".split()
)
BEFORE_NUMBER = set(
    "no nos nr n fig figs vol vols ch chap sec art arts p pp pg approx ca c cf eq ref tab abs bd kap s seite pág págs "
    "núm aprox cap env éd num рис стр ст п гл табл см ок пр".split()
)
CAN_END = set("a.m p.m am pm etc ltd inc co corp bros jr sr pct usw etc u.s u.k e.u std min max др пр т.д т.п г".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
ORDINAL_LEAD = set("am vom zum bis dem der den des im zur ab seit".split())
SPEECH = re.compile("[问说道答喊叫讲問]")
QUOTED_ON = re.compile(r"\s*(?:と|って|하고|라고|이라고|고 )")
LIST_ITEM = re.compile(r"[ \t]*(?:[-*•‣▪◦·–+]|\(?\d{1,3}[.)]|[（(]\d{1,3}[)）]|[a-z]\))[ \t 　]+|[ \t]*(?:•|\d{1,3}、)")
HEADING = re.compile(r"[ \t]*#{1,6}[ \t]")
GAP = re.compile(
    rf"(?P<m>[{MARKS}]+)(?P<t>(?:[{CLOSERS}]|[   ][»›](?=\s|[,.;:!?]|$)|[ \t]?\[\d{{1,3}}(?:[ ]?[,–-][ ]?\d{{1,3}})*\]|[ \t]{{0,2}}[{EMOJI}]+)*)(?P<s>[\s﻿]*)"
    r"|(?P<n>[^\S\n\r]*[\n\r][\s﻿]*)|(?P<b>[^\S\n\r]+)"
)
NO_BLANKS = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
END_MARK = re.compile(r"[!?…。！？｡।॥؟۔]|\.(?!\w)")
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "【": "】", "[": "]", '"': '"'}
STRIPPED = re.compile(rf"(?P<end>[{MARKS}]+[{CLOSERS}]*)(?P<gap>\s*)|(?P<mark>[，、；：,;:“”‘’「」『』（）()《》\"])|.", re.S)
SMILE = re.compile(rf"[{EMOJI}]")
QUOTE = re.compile(r"[“”„«»‹›「」『』（）()《》【】\[\]\"]")
TOKEN = re.compile(r"(?:[\w.'’-]|[̀-ͯऀ-෿])*(?:\w|[̀-ͯऀ-෿])$")
TOUCHING = re.compile(r"\S(?=(\S))")
BREAK = re.compile(r"[\n\r][^\S\n\r]*[\n\r]")


def _kind(c: str) -> str:
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper() or c.istitle():
        return "upper"
    o = ord(c)
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x0E00 <= o <= 0x0EFF:
        return "noblank"
    if 0xAC00 <= o <= 0xD7AF:
        return "hangul"
    if c.isalpha():
        return "letter"
    if c in OPENERS or c in "\\":
        return "open"
    if c in "-–—":
        return "dash"
    if c in ",;:，；：、،؛)）]":
        return "comma"
    return "other"


def _before(text: str, at: int, known: set[str]) -> str:
    """The class of what stands before a full stop."""
    token = TOKEN.search(text, max(0, at - 24), at)
    if not token:
        return "closed" if at and text[at - 1] in CLOSERS else "none"
    word = re.split("['’]", token[0].lstrip(".'’-"))[-1]
    low = word.lower()
    if low.replace(".", "").replace(",", "").isdigit():
        lead = TOKEN.search(text[max(0, token.start() - 12) : token.start()].rstrip())
        after = re.match(r"\s*(\w+)", text[at + 1 : at + 16])
        if word.isdigit() and len(word) <= 2 and (
            (after and after[1].lower() in MONTHS) or (lead and lead[0].lower() in ORDINAL_LEAD)
        ):
            return "ordinal"
        return "number"
    if low in TITLES and not word.isupper() or len(word) == 1 and low in TITLES and not word.isascii():
        return "title"
    if len(word) == 1 and word.isalpha():
        return "initial" if word.isupper() or not (word.islower() or ord(word) > 0x2FFF) else "small"
    if low in CAN_END:
        return "can_end"
    if low in BEFORE_NUMBER:
        return "before_number"
    if "." in low and all(len(x) <= 2 for x in low.split(".")):
        return "pointed"
    if low in known:
        return "learnt"
    return "word"


def places(text: str, known: set[str] = frozenset()) -> list[tuple[int, tuple]]:
    """(start of what follows, signature) of every character that may start a sentence, in order."""
    out: list[tuple[int, tuple]] = []
    blocks = [0, *[m.end() for m in BREAK.finditer(text)], len(text)]
    block = -1
    unmarked = item = heading = False
    opened: list[tuple[str, bool]] = []  # open quotes and brackets: the closing character, whether at a start
    scanned = 0

    def read_line(at: int, ended: bool) -> None:
        nonlocal item, heading
        heading = bool(HEADING.match(text, at))
        item = bool(LIST_ITEM.match(text, at)) or (item and not heading and not ended)

    def scan(upto: int) -> bool:
        """Reads quotes and brackets on; whether one that began a sentence was closed."""
        nonlocal scanned
        closed_start = False
        for q in QUOTE.finditer(text, scanned, upto):
            c, i = q[0], q.start()
            if opened and c in opened[-1][0]:
                closed_start = opened.pop()[1]
            elif c in PAIRS:
                lead = text[max(blocks[block], i - 12) : i].rstrip().rstrip(OPENERS)
                at_start = not lead.strip() or lead.rstrip(CLOSERS)[-1:] in MARKS or bool(LIST_ITEM.fullmatch(text, text.rfind("\n", 0, i) + 1, i))
                opened.append((PAIRS[c], at_start and c not in "（(《【["))
        scanned = max(scanned, upto)
        return closed_start

    for m in GAP.finditer(text):
        # paragraphs: quotes don't reach across them, and each is marked or unmarked as a whole
        while block < 0 or (block + 1 < len(blocks) - 1 and m.start() >= blocks[block + 1]):
            block += 1
            body = text[blocks[block] : blocks[block + 1]]
            unmarked = not END_MARK.search(body) and len(NO_BLANKS.findall(body)) * 3 > len(body.strip())
            if unmarked:
                out += [(blocks[block] + c.start() + 1, ("char", c[0], c[1])) for c in TOUCHING.finditer(body)]
            opened.clear()
            scanned, item = blocks[block], False
            read_line(blocks[block], True)
        mark, gap = m["m"], m["s"] if m["m"] else m["n"] or m["b"]
        if m["b"] is not None and not unmarked:
            continue
        start = m.end()
        if start >= len(text):
            break
        tail = m["t"] or ""
        closed_start = scan(m.start() + len(mark or "") + len(tail))
        broken = 2 if BREAK.search(gap) else 1 if ("\n" in gap or "\r" in gap) else 0
        kind = _kind(text[start])
        if mark and not gap and not tail and kind not in ("upper", "noblank", "hangul", "letter", "open"):
            continue  # within a number, a name of a file or an address
        line = "text"
        if broken:
            line = "item" if LIST_ITEM.match(text, start) else "heading" if HEADING.match(text, start) else "text"
        if not m.start():
            continue
        before = ""
        if mark:
            what = "stop" if mark == "." else "dots" if set(mark) <= {".", "…"} else "wide" if mark[-1] in "。！？｡।॥" else "ask"
            if what == "stop":
                before = _before(text, m.start(), known)
        else:
            what = "none"
        depth = bool(opened)
        speech = ""
        if closed_start or any(c in tail for c in "」』”"):
            if QUOTED_ON.match(text, start):
                speech = "on"
            elif closed_start and kind == "noblank":
                end = END_MARK.search(text, start)
                rest = text[start : end.start() if end else min(len(text), start + 40)]
                if len(rest) <= 14 and SPEECH.search(rest):
                    speech = "said"
        ending = "smile" if SMILE.search(tail) else "closed" if any(c in CLOSERS for c in tail) else ""
        shape = "" if not gap else " " if not broken else "n" if broken == 1 else "nn"
        inside = "item" if item else "heading" if heading else "text"
        out.append((start, (what, shape, kind, before, line, inside, depth, speech, unmarked, ending)))
        if broken:
            read_line(start, what != "none" and kind != "lower" and not depth)
    return sorted(out, key=lambda place: place[0])


def teach(signature: tuple) -> bool:
    """Whether a place is a boundary, where punctuation, layout and case make it plain; the tags of training texts."""
    if signature[0] == "char":
        return False
    what, shape, kind, before, line, inside, depth, speech, unmarked, ending = signature
    if shape == "nn" or line != "text":
        return True
    if inside == "heading":
        return shape == "n"
    if inside == "item":  # whole, unless it has ended and running text follows on the next line
        return shape == "n" and what != "none" and kind != "lower" and not depth and before in ("", "word", "number", "closed", "can_end")
    if unmarked:
        return shape in (" ", "n")
    if what == "none" or depth or speech or kind in ("comma", "dash"):
        return False
    if what == "wide":
        return True
    if kind == "lower":  # a name in small letters may begin a sentence, if no abbreviation stands before
        return what == "stop" and before in ("word", "number", "closed") or what == "ask" and not ending
    if what == "dots":
        return kind in ("upper", "open") or ending == "smile" or (kind == "digit" and shape != "")
    if what == "ask":
        return not (shape == "" and kind == "digit")
    if before in ("title", "initial", "ordinal", "small"):
        return False
    if before in ("before_number", "learnt") and kind == "digit":
        return False
    if shape == "" and before in ("none",):
        return False
    return True


def features(signature: tuple) -> list[tuple]:
    """Parts of what is seen at a place."""
    if signature[0] == "char":
        _, left, right = signature
        return [("char",), ("left", left), ("right", right)]
    what, shape, kind, before, line, inside, depth, speech, unmarked, ending = signature
    marked = what != "none"
    return [
        ("bias", inside, unmarked), ("mark", what, shape, inside), ("kind", what, kind, shape, inside), ("word", before, kind), ("word before", what, before, inside),
        ("held", depth, inside), ("said", speech), ("layout", shape, line, inside), ("line", line), ("open", unmarked, shape, marked), ("ending", what, kind, ending),
        ("item", inside, marked, kind == "lower", depth, shape),
    ]


def decode(signatures: list[tuple], weights: dict) -> list[bool]:
    """The best tags of a document's places by Viterbi: emissions of each place, transitions between tags."""
    moves = {c: [weights.get(("t", a, b, c), 0.0) for a in (False, True) for b in (False, True)] for c in (False, True)}
    inside, boundary, back = 0.0, float("-inf"), []  # before the first place stands no boundary
    memo = weights.setdefault("memo", {})
    for s in signatures:
        score = memo.get(s)
        if score is None:
            score = memo[s] = sum(weights.get(f, 0.0) for f in features(s))
        keep, open_, close, same = moves[s[0] == "char"]
        from_inside = inside + open_ >= boundary + same
        stay = inside + keep >= boundary + close
        back.append((not stay, not from_inside))
        inside, boundary = max(inside + keep, boundary + close), max(inside + open_, boundary + same) + score
    tags, tag = [], boundary > inside
    for from_b_if_inside, from_b_if_boundary in reversed(back):
        tags.append(tag)
        tag = from_b_if_boundary if tag else from_b_if_inside
    return tags[::-1]


def unpunctuated(text: str) -> tuple[str, set[int]]:
    """Text of a script without blanks without its marks, and where in it something stands after an end mark taken out.

    An end mark leaves a blank, a line end stays.
    """
    out, ends, size, ended = [], set(), 0, False
    for m in STRIPPED.finditer(text):
        if m["end"] is not None:
            ended = True
            kept = "\n" if "\n" in m["gap"] else " "
        elif m["mark"] is not None:
            continue
        else:
            kept = m[0]
            if ended and not kept.isspace():
                ends.add(size)
                ended = False
        out.append(kept)
        size += len(kept)
    return "".join(out), ends


def tagged(text: str, known: set[str]) -> Iterator[tuple[list[tuple], list[bool]]]:
    """Signatures and tags to train on: of a text, and of the same without its marks in a script without blanks."""
    found = [s for _, s in places(text, known)]
    yield found, [teach(s) for s in found]
    if len(NO_BLANKS.findall(text)) * 3 > len(text):
        # paragraphs that had no marks to begin with tell nothing about where they stood
        bare, ends = unpunctuated("\n\n".join(p for p in BREAK.split(text) if END_MARK.search(p)))
        found = places(bare, known)
        yield [s for _, s in found], [_was_end(s, at in ends) for at, s in found]


def _was_end(signature: tuple, ended: bool) -> bool:
    """The tag of a place of a text without its marks; a heading or a list item is a unit, with marks or without."""
    if signature[0] == "char":
        return ended
    _, shape, _, _, line, inside, *_ = signature
    return shape == "nn" or line != "text" or inside == "heading" and shape == "n" or inside == "text" and ended


def train(texts: list[str], known: set[str] = frozenset(), epochs: int = 20) -> dict:
    """Weights of a structured perceptron, averaged over the second half of its epochs."""
    documents = [(s, t) for text in texts for s, t in tagged(text, known) if s]
    weights: dict = defaultdict(float)
    total: dict = defaultdict(float)
    step = 1
    for epoch in range(epochs):
        wrong = 0
        if epoch == epochs // 2:
            total, step = defaultdict(float), 1
        for signatures, truth in documents:
            guess = decode(signatures, weights)
            if guess != truth:
                wrong += 1
                weights.pop("memo")  # of the weights as they were
                for tags, sign in ((truth, 1.0), (guess, -1.0)):
                    last = False
                    for s, tag in zip(signatures, tags):
                        for f in [*(features(s) if tag else []), ("t", last, tag, s[0] == "char")]:
                            weights[f] += sign
                            total[f] += sign * step
                        last = tag
            step += 1
        if not wrong:  # every tag of the sample is right: these weights, not their average
            weights.pop("memo", None)
            return dict(weights)
    weights.pop("memo", None)
    return {f: w - total[f] / step for f, w in weights.items()}


def abbreviations(df: DataFrame, text_col: str, least: int = 5, share: float = 1e-4) -> set[str]:
    """Words with a full stop that, over all texts, at least half of the time go on with a small letter or a digit.

    Counted in Spark with partial aggregation; only words that make up ``share`` of all those seen are kept, so that no
    more than 1 / share words come to the driver.
    """
    stops = F.explode(F.regexp_extract_all(text_col, F.lit(r"(?U)\b\w{2,8}\.\s+\w"), F.lit(0))).alias("m")
    seen = df.where(F.contains(F.col(text_col), F.lit(". "))).select(stops).select(
        F.lower(F.regexp_extract("m", r"(?U)^(\w+)\.", 1)).alias("word"), F.col("m").rlike(r"[\p{Ll}\p{Nd}]$").cast("int").alias("small")
    )
    counted = seen.where("word not rlike '^[0-9]+$'").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("small").alias("small"))
    counted = cut(counted.where(F.col("n") >= least))
    all_seen = counted.agg(F.sum("n").alias("all_seen"))
    return {r["word"] for r in counted.where("small * 2 >= n").join(F.broadcast(all_seen)).where(F.col("n") >= F.col("all_seen") * share).collect()}


def starts(text: str, weights: dict, known: set[str]) -> list[int]:
    """Positions of the first visible characters of the sentences of a text."""
    first = next((i for i, c in enumerate(text) if not c.isspace() and c != "﻿"), None)
    if first is None:
        return []
    found = [(at, s) for at, s in places(text, known) if at > first]
    tags = decode([s for _, s in found], weights)
    return [first, *[at for (at, _), tag in zip(found, tags) if tag]]


def sample_of(df: DataFrame, id_col: str, text_col: str, size: int) -> list[str]:
    """At most size texts to train on, chosen by a hash of their id, whatever their length."""
    chosen = (
        df.where(F.length(text_col) > 0)
        .select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("t"))
        .orderBy("h", "t")
        .limit(size)
    )
    return [r["t"] for r in chosen.collect()]


def sentence_units(
    df: DataFrame, id_col: str, text_col: str, sample_size: int = 3000, with_text: bool = True
) -> DataFrame:
    """One row per sentence: <id_col>, sentence_no (from 1), start_pos and, with_text, sentence.

    start_pos is the 0-based code point position of the first character that is neither blank nor a byte-order
    mark; a sentence reaches to the next one, without the blanks at its end. A heading and a list item are units.
    Texts that are null, empty or blank give no rows; repeated rows give theirs each time; a text is read
    whole, whatever its length. sample_size bounds the documents that the model is trained on.
    """
    known = abbreviations(df, text_col)
    sent = df.sparkSession.sparkContext.broadcast((train(sample_of(df, id_col, text_col, sample_size), known), known))

    @F.pandas_udf("array<struct<start_pos: bigint, sentence: string>>")
    def units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, known = sent.value
        weights = dict(weights)
        for batch in batches:
            yield batch.map(lambda t: _units(t, weights, known, with_text))

    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") > 0)
    out = rows.select("__id", F.posexplode(units("__text")).alias("__no", "u"))
    columns: list[Column] = [F.col("__id").alias(id_col), (F.col("__no") + 1).alias("sentence_no"), F.col("u.start_pos").alias("start_pos")]
    return out.select(*columns, *([F.col("u.sentence").alias("sentence")] if with_text else []))


def _units(text: str | None, weights: dict, known: set[str], with_text: bool) -> list[dict]:
    if not text:
        return []
    at = starts(text, weights, known)
    ends = [*at[1:], len(text)]
    return [{"start_pos": a, "sentence": text[a:b].rstrip() if with_text else None} for a, b in zip(at, ends)]
