"""Problem 1: broken prompt and response pairs.

A response is cut into clauses, and a linear-chain conditional random field tags each as answer, refusal, echo,
foreign or unfinished. The tags' coverage of the response decides whether the pair has a defect, and which. The
field is trained here, on a bounded sample of pairs, from defects that are made: questions given back, refusals put
in an answer's place, answers in other languages, responses cut off or left open. So each clause's label is known by
how it was made, not by a rule over what the field sees: the words of a clause, how much it shares with the question,
how likely each language is, how it ends, and the tags beside it. Pairs that the field, once trained, takes for
defective are no longer training answers when it is trained again.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
BUCKETS = 1 << 14

# Words that show a language, placeholders, refusals in the first person.
WORDS = {
    "en": "the of and to in is are was with for on that by while before after be how what who why when can please does did which has had from our an this it one under without since because until at as so all not no yes only owner explain describe list summarise hi thanks",
    "de": "der die das und ist mit vor nach unter ohne wie warum bitte im seit den dem des ein eine nicht auf für von zu bei trotz nur beschreibe kurz auch wer was wann mir ich diese leider ihre es sind wird",
    "fr": "de le la les des et est une un dans avec sans pour sur que qui du au aux en par pas plus ne ce cette pourquoi comment quand vous nous je désolé à après avant pendant malgré il elle sont peux",
    "es": "de a el la los las y es una un en con sin para por que del al se no su como cómo qué quién cuándo lo por tras antes durante más este esta son fue brevemente puedo siento ante falta",
    "it": "il lo gli di che è una un con per non del della sono dei nel alla perché come quando questo",
    "pt": "o os as um uma de que não para com do da em no na por mais como são foi está isso você",
}
SCRIPTS = {"ja": "぀-ヿ", "zh": "㐀-鿿", "ko": "가-힯", "ru": "Ѐ-ӿ", "ar": "؀-ۿ", "hi": "ऀ-ॿ", "th": "฀-๿"}
MARKED = {"de": "äöüß", "fr": "èêàçùîôœëï", "es": "ñ¿¡", "pt": "ãõ"}
STOP = {w: [l for l in WORDS if w in WORDS[l].split()] for ws in WORDS.values() for w in ws.split()}
PLACEHOLDERS = set("n/a na none null nil nan undefined empty placeholder tbd todo 空 无内容 待补充 暂无 未填写 なし 空白".split())
# Sentences that decline, put in place of answers in training; fixed values.
DECLINE = {
    "en": [
        "I cannot help with that.", "I'm not able to answer this question.", "I am unable to share that information.", "I can't provide an answer to this.",
        "I must decline to answer.", "I have to refrain from any comment on it.", "I won't be able to give details on this.", "I am not allowed to discuss this.",
        "This cannot be answered from the documents I have.", "There is not enough material here for me to answer.", "I don't have enough information to reply.",
        "I don't have access to that data.", "My rules do not let me give an answer.", "Answering this is outside of what I may do.", "That is something I have to decline.",
        "I apologise; I have to decline this.", "The passages I was given do not let me answer.", "This request is beyond what I can respond to.", "I will not comment on this topic.", "I could not find anything to answer it with.", "No answer can be given by me.",
    ],
    "zh": [
        "我无法回答这个问题。", "这个问题我不便作答。", "我不能提供这方面的内容。", "该请求超出了我的权限，恕难答复。", "现有资料不足以支持我给出答复。", "知识库中没有能用来回答的内容。",
        "这类内容我需要婉拒。", "我没有办法回应这个请求。", "恕我不能透露。", "我无权讨论这个话题。", "暂时没法给您答案。", "我必须拒绝这个请求。", "我不能对此发表意见。", "没有可供我答复的依据。", "检索结果里没有依据，我没法作答。", "资料不足，不能支持我作出回答。", "这方面的说明我不能提供。",
    ],
    "de": [
        "Dazu kann ich keine Auskunft geben.", "Darauf kann ich nicht antworten.", "Diese Frage darf ich nicht beantworten.", "Mir fehlen die Unterlagen, um darauf zu antworten.",
        "Ich muss diese Anfrage ablehnen.", "Dabei kann ich Ihnen nicht helfen.", "Dazu möchte ich mich nicht äußern.", "Mir liegen keine Informationen vor.", "Das geht über meine Befugnisse hinaus.",
    ],
    "fr": [
        "Je ne peux pas répondre à cette question.", "Je ne suis pas en mesure de vous aider.", "Je dois décliner cette demande.", "Il me manque les documents pour répondre.",
        "Je ne dispose pas des informations nécessaires.", "Je n'ai pas le droit d'en parler.", "Cela dépasse ce que je peux faire.", "Je préfère ne pas me prononcer.", "Je n'ai pas assez d'éléments pour répondre.",
    ],
    "es": [
        "No puedo responder a esta pregunta.", "No me es posible ayudar con eso.", "Debo rechazar esta petición.", "No dispongo de material para contestar.",
        "No tengo información suficiente.", "No estoy autorizado a hablar de ello.", "Prefiero no opinar sobre este tema.", "Eso queda fuera de mis atribuciones.",
    ],
    "ja": [
        "その質問にはお答えできません。", "お手伝いすることはできません。", "回答いたしかねます。", "回答に必要な資料がありません。", "その件についてはお話しできません。", "ご依頼はお断りします。", "私の権限を超えています。", "資料が足りず、回答できません。", "根拠となる資料がないため、お答えできません。",
    ],
    "it": ["Non posso rispondere a questa domanda.", "Non sono in grado di aiutare.", "Devo rifiutare questa richiesta."],
    "pt": ["Não posso responder a esta pergunta.", "Não tenho informação suficiente.", "Devo recusar este pedido."],
    "ko": ["그 질문에는 답변할 수 없습니다.", "도와드릴 수 없습니다.", "요청을 거절해야 합니다.", "답변에 필요한 자료가 없습니다."],
    "ru": ["Я не могу ответить на этот вопрос.", "К сожалению, не могу помочь.", "Вынужден отклонить этот запрос.", "У меня нет данных для ответа."],
}
BEFORE_DECLINE = {
    "en": ["", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "Hello. ", "As an assistant, "], "zh": ["", "抱歉，", "很遗憾，", "您好，", "对不起，", "作为助手，"],
    "de": ["", "Leider: ", "Es tut mir leid. ", "Guten Tag. "], "fr": ["", "Je suis désolé. ", "Désolé, ", "Bonjour. "], "es": ["", "Lo siento. ", "Lamentablemente, "],
    "ja": ["", "申し訳ありませんが、", "恐れ入りますが、"],
}
AFTER_DECLINE = {
    "en": ["", "", " Please contact your administrator.", " Feel free to ask me something else!", " Is there another topic I can help with?", ", I hope you understand.", " Such requests go to the owners of the documents, who look into them on working days."], "zh": ["", "", "，望理解。", "这类请求由资料的负责人在工作日处理。", "请联系管理员。", "您可以换个话题再问。", "如需帮助请联系负责人。"],
    "de": ["", "", " Bitte wenden Sie sich an die Leitung.", " Fragen Sie gern etwas anderes."], "fr": ["", "", " Veuillez contacter votre administrateur.", " Posez-moi une autre question."],
    "es": ["", "", " Contacte con su administrador.", " Puede preguntar otra cosa."], "ja": ["", "", "管理者にお問い合わせください。", "別の質問をどうぞ。"],
}
IN_LANGUAGE = {
    "zh": r"chinese|mandarin|中文|汉语|chinesisch|chinois|chino|中国語",
    "ja": r"japanese|日文|日语|japanisch|japonais|japonés|日本語",
    "de": r"german|德文|德语|deutsch|allemand|alemán|ドイツ語",
    "fr": r"french|法文|法语|französisch|français|francés|フランス語",
    "es": r"spanish|西班牙文|西班牙语|spanisch|espagnol|español|スペイン語",
    "en": r"english|英文|英语|englisch|anglais|inglés|英語",
    "ko": r"korean|韩文|韩语|koreanisch|coréen|coreano|韓国語",
    "ru": r"russian|俄文|俄语|russisch|russe|ruso|ロシア語",
}
REQUEST = {
    l: re.compile(rf"(?:\bin (?:{w})\b|用(?:{w})|(?:{w})(?:で|回答|作答|回复)|\bauf (?:{w})\b|\ben (?:{w})\b)", re.I) for l, w in IN_LANGUAGE.items()
}
EMOJI = r"[\U0001f000-\U0001faff☀-➿⬀-⯿️]"
ITEM = re.compile(r"\s*(?:[-*•‣]|\d{1,3}[.)、])(?:\s+|$)")
PART = re.compile(r"[^。！？!?…\n.]*(?:[。！？!?…]+|\.+(?=\s|$|[\"”’)\]\[])|\.|\n|$)[\"”’」』）)\]》]*")
LINK = re.compile(r"https?://\S+$")
DANGLING = re.compile(
    r"(?:的|和|与|及|以及|或|在|把|被|因为|但是|而|以|将|对|向|从|由|共|之|也|，|、|：|[,;:(\[{=+])$"
    r"|\b(?:the|a|an|of|and|or|to|in|on|at|for|with|by|from|that|which|is|are|was|because|but|so|der|die|das|und|mit|de|la|le|et|el|y|que|en|con)$|(?:下|里|内|前|后|时|期间)$",
    re.I,
)
OPENING = re.compile(r"^(?:the|a|an|our|one of|der|die|das|le|la|les|el|los|las|un|une)\b", re.I)


LANGUAGES = [*WORDS, *SCRIPTS]
SCRIPT = {l: re.compile(f"[{r}]") for l, r in SCRIPTS.items()}
LATIN = re.compile(r"[a-zà-öø-ÿœ]+")


def plain(text: str) -> str:
    """Letters and digits in lower case."""
    return re.sub(r"[\W_]+", "", text.lower())


@lru_cache(maxsize=4096)
def _scores(text: str) -> tuple[float, ...]:
    low = text.lower()
    words = LATIN.findall(low)
    score = dict.fromkeys(LANGUAGES, 0.0)
    for w in words:
        for l in STOP.get(w, ()):
            score[l] += 1.0 / len(STOP[w])
    if not text.isascii():
        for l, marks in MARKED.items():
            score[l] += 0.8 * sum(low.count(c) for c in marks)
        n = {l: len(r.findall(text)) for l, r in SCRIPT.items()}
        rest = 2 * len(words)
        kana, han = n.pop("ja"), n.pop("zh")
        is_ja = kana > 1 and kana * 8 > han
        score["ja"] = float((kana + han) / 2 if is_ja and kana + han > len(words) else 0)
        score["zh"] = float(han / 2 if not is_ja and han >= 2 and han >= rest else 0)
        for l, k in n.items():
            score[l] = float(k / 2 if k >= 3 and k > rest else 0)
        if max(score[l] for l in SCRIPT) > 0:
            score.update(dict.fromkeys(WORDS, 0.0))
    return tuple(score.values())


def language_scores(text: str) -> dict[str, float]:
    """Evidence for each language: its script, and its common words and letters where the script is Latin."""
    return dict(zip(LANGUAGES, _scores(text)))


def language(text: str) -> str:
    """The main language of a text; '' if nothing shows it."""
    score = language_scores(text)
    order = sorted(score, key=score.get, reverse=True)
    return order[0] if score[order[0]] >= 0.9 and score[order[0]] > score[order[1]] else ""


def relation_to(text: str, wanted: str) -> str:
    """same, other or none: other only where another language is clearly more likely than the one wanted."""
    if not wanted:
        return "none"
    score = _scores(text)
    best = max(score)
    if best < 0.9:
        return "none"
    return "same" if score[LANGUAGES.index(wanted)] >= 0.6 * best else "other"


@lru_cache(maxsize=4096)
def expected_language(query: str) -> str:
    """The language the question asks for, else the one it is written in."""
    for l, pattern in REQUEST.items():
        if pattern.search(query):
            return l
    return language(query)


def is_empty(text: str) -> bool:
    """Nothing but blanks, marks, empty markup or a placeholder."""
    bare = re.sub(r"<[^<>]{0,40}>|```\w*|&nbsp;|[*_#>`|~]", " ", text)
    bare = re.sub(rf"[\s​-‏⁠﻿­]|{EMOJI}", "", bare).strip("()[]{}（）【】<>\"'“”‘’「」.,;:!?。，；：！？…—–-·、/\\=+")
    return not bare or bare.lower() in PLACEHOLDERS


def clauses(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the clauses: text, item, marker, code, open_code, data or link; marks go with what they end."""
    out: list[tuple[str, str]] = []
    for i, block in enumerate(re.split(r"(```.*?(?:```|\Z))", text, flags=re.S)):
        if i % 2:
            out.append(("code" if block.endswith("```") and len(block) >= 6 else "open_code", block))
            continue
        for line in block.split("\n"):
            if not line.strip():
                continue
            if m := ITEM.match(line):
                out.append(("item" if line[m.end() :].strip() else "marker", line))
            elif LINK.match(line.strip()):
                out.append(("link", line))
            elif line.lstrip()[:1] in "{[" and re.match(r"\s*[{\[]\s*[\"{\[\d]", line):
                out.append(("data", line))
            else:
                held = ""
                for m in PART.finditer(line):
                    held += m[0]
                    if not m[0]:
                        continue
                    ends = re.search(r"(?:[。！？!?…]|\.(?=[\"”’」』）)\]》]*$))[\"”’」』）)\]》]*$", m[0]) and line[m.end() : m.end() + 1] not in ("",) or m.end() == len(line)
                    if ends and (m.end() == len(line) or m[0][-1] != "." or line[m.end() : m.end() + 1] in (" ", "[", "\t")):
                        if plain(re.sub(r"\[\d+\]", "", held)) or not out:
                            out.append(("text", held))
                        else:
                            out[-1] = (out[-1][0], out[-1][1] + held)
                        held = ""
                if held.strip():
                    out.append(("text", held)) if plain(held) or not out else out.append((out.pop()[0], out[-1][1] + held if out else held))
    return out


def ending(kind: str, text: str, single: bool) -> str:
    """How the last clause of a response ends."""
    tail = text.rstrip()
    if kind in ("open_code", "marker"):
        return "open"
    if kind == "data":
        return "closed" if all(tail.count(a) == tail.count(b) for a, b in ("{}", "[]")) and tail.count('"') % 2 == 0 else "open"
    if kind in ("item", "code", "link"):
        return "closed"
    if re.search(rf"(?:\[\d+\]|{EMOJI})\s*$", tail) or LINK.search(tail.split(" ")[-1]):
        return "closed"
    if re.search(r"[.!?。！？…][\"'”’»」』）)\]]*$", tail):
        return "mark"
    if re.search(r"[”」』\"’»）)*>]$", tail) and not DANGLING.search(tail):
        return "closed"
    if single:
        han, words = len(re.findall(r"[㐀-鿿぀-ヿ가-힯]", tail)), len(tail.split())
        short = han <= 5 if han else words <= 2
        if short and not DANGLING.search(tail) and not OPENING.match(tail):
            return "bare"
    return "cut"


def _echo(clause: str, query: str, grams: set[str]) -> float:
    if len(clause) < 4 or not query:
        return 0.0
    n = [clause[i : i + 3] for i in range(len(clause) - 2)]
    return sum(map(grams.__contains__, n)) / max(1, len(n))


LETTERED = re.compile(r"[a-zà-öø-ÿœа-яё']+")
UNSIGNED = re.compile(r"[^㐀-鿿぀-ヿ가-힯]+")


@lru_cache(maxsize=200_000)
def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def _level(share: float) -> int:
    return min(5, int(share * 5 + 0.05))


class Pair:
    """One pair with the clauses of its response and their features; labels, where they are known, one per clause."""

    def __init__(self, query: str | None, content: str, labels: list[int] | None = None):
        self.clauses = clauses(content)
        self.known = labels
        query = query or ""
        q = plain(query)
        grams = {q[i : i + 3] for i in range(len(q) - 2)}
        wanted = expected_language(query)
        texts = [plain(t) for _, t in self.clauses]
        self.size = [max(1, len(t)) for t in texts]
        self.features, self.ends = [], []
        single = len(self.clauses) == 1
        whole = "".join(texts)
        all_held = _level(_echo(whole, q, grams))
        given = {whole[i : i + 3] for i in range(len(whole) - 2)}
        asked = _level(sum(g in given for g in grams) / max(1, len(grams)))  # how much of the question the response gives back
        beyond = _level(len(whole.replace(q, "")) / max(1, len(whole))) if len(q) >= 4 else 5  # what stands beside the question itself
        longer = min(6, round(2 * np.log2((len(whole) + 4) / (len(q) + 4)))) if q else 7
        for i, (kind, text) in enumerate(self.clauses):
            last = i == len(self.clauses) - 1
            p = texts[i]
            level = _level(_echo(p, q, grams)) if len(p) >= 4 else 0
            relation = "none" if kind in ("code", "open_code", "data", "link") else relation_to(text, wanted)
            end = ending(kind, text, single) if last else "inner"
            self.ends.append(end)
            size = min(6, len(p).bit_length())
            tail = text.rstrip()[-1:]
            names = [
                "bias", f"end {end}", f"rel {relation}", f"echo {level}", f"kind {kind}", f"size {size}", f"first {i == 0} {last}", f"er {level} {relation}",
                f"ek {end} {kind}", f"el {level} {size}", f"ae {asked} {level}", f"al {asked} {longer}", f"ah {asked} {all_held} {longer > 1}", f"tail {last} {tail if not tail.isalnum() else 'letter'}",
                f"rs {relation} {size}", f"beyond {beyond} {asked}", f"be {beyond} {level}",
            ]
            plain_names = len(names)
            low = text.lower()
            words = LETTERED.findall(low)
            names += [f"w {w}" for w in words] + [f"b {a} {b}" for a, b in zip(words, words[1:])]
            if not low.isascii():
                signs = UNSIGNED.sub(" ", low)
                names += [f"c {signs[j : j + 2]}" for j in range(len(signs) - 1) if " " not in signs[j : j + 2]]
            # the words of a clause together weigh as much as a few other features
            lexical = max(1, len(names) - plain_names)
            values = np.full(len(names), min(1.0, 5.0 / lexical))
            values[:plain_names] = 1.0
            self.features.append((np.fromiter(map(_bucket, names), dtype=np.int64, count=len(names)), values))

    def labels(self) -> list[int]:
        """What the clauses are known to be; answers, if nothing is known."""
        return self.known if self.known is not None else [ANSWER] * len(self.clauses)


INTRODUCED = ["", "> ", "You asked: ", "Question: ", "Your question was: ", "您的问题是：", "问题：", "ご質問：", "Frage: ", "Question : ", "Pregunta: ", "“", "\n"]
LED = {"en": "You asked about {}. ", "zh": "您想了解{}。", "de": "Sie fragten nach {}. ", "fr": "Vous demandez {}. ", "es": "Usted pregunta por {}. ", "ja": "{}についてのご質問ですね。"}
LEFT_OPEN = ["\n1. a\n2.", "\n- ", "\n```python\nfor row in rows:\n    x = (", "\n```\ncommand --", '\n{"step": 1, "target": "the', '\n[{"a": 1}, {"b"']


def _made(query: str | None, content: str, label: int, only_last: bool = False) -> Pair:
    pair = Pair(query, content)
    n = len(pair.clauses)
    pair.known = [ANSWER] * (n - 1) + [label] * min(1, n) if only_last else [label] * n
    return pair


def with_made_defects(pairs: list[tuple[str | None, str]], seed: int = 11) -> list[Pair]:
    """The pairs as answers, and for a part of them copies with a defect made, whose labels are known by how they were made."""
    rng = random.Random(seed)
    out = [Pair(q, c) for q, c in pairs]
    by_language: dict[str, list[str]] = {}
    for q, c in pairs:
        if len(c) > 12:
            by_language.setdefault(language(c), []).append(c)
    by_language.pop("", None)
    for i, (query, content) in enumerate(pairs):
        wanted = expected_language(query or "")
        if i % 8 == 0 and query and query.strip():
            out.append(_made(query, rng.choice(INTRODUCED) + rng.choice([query.strip(), query.strip(), query.upper(), query.strip(" 。.?？!！"), f"{query.strip()} {query.strip()}", query.strip() * 2]), ECHO))
        elif i % 8 == 1 and len(content) > 24:  # cut within its last sentence
            out.append(_made(query, content[: rng.randint(max(12, len(content) // 3), len(content) - 2)].rstrip(" .。!！?？"), UNFINISHED, True))
        elif i % 8 == 2:
            out.append(_made(query, content.rstrip() + rng.choice(LEFT_OPEN), UNFINISHED, True))
        elif i % 8 in (3, 4):
            tongue = wanted if wanted in DECLINE and i % 3 else rng.choice(list(DECLINE))
            lead = LED[tongue].format((query or "").strip(" ?？。.")[-14:]) if tongue in LED and i % 3 == 0 else ""
            out.append(_made(query, lead + rng.choice(BEFORE_DECLINE.get(tongue, [""])) + rng.choice(DECLINE[tongue]) + rng.choice(AFTER_DECLINE.get(tongue, [""])), REFUSAL))
        elif i % 8 == 5 and wanted and len(by_language) > 1:
            other = rng.choice([l for l in by_language if l != wanted] or [""])
            if other:
                out.append(_made(query, rng.choice(by_language[other]), FOREIGN))
    return [p for p in out if p.clauses]


def _grams(text: str) -> set[str]:
    low = text.lower()
    signs = re.sub(r"[^㐀-鿿぀-ヿ가-힯]+", " ", low)
    return {*re.findall(r"[a-zà-öø-ÿœа-яё']+", low), *(signs[j : j + 2] for j in range(len(signs) - 1) if " " not in signs[j : j + 2])}


DECLINING = [_grams(s) for those in DECLINE.values() for s in those]


def _doubtful(query: str | None, content: str) -> bool:
    """Whether a pair shows any sign of a defect, so that it had better not teach what an answer is."""
    pair = Pair(query, content)
    q, wanted = plain(query or ""), expected_language(query or "")
    whole = "".join(plain(t) for _, t in pair.clauses)
    if pair.ends[-1:] != ["bare"] and pair.ends[-1:] in (["cut"], ["open"]) or not pair.clauses:
        return True
    if len(q) >= 4 and q in whole and len(whole) < 2 * len(q) or whole and whole in q:
        return True
    held = [_grams(t) for _, t in pair.clauses]
    near = any(len(g & d) >= 0.5 * min(len(g), len(d)) and len(g & d) > 1 for g in held if g for d in DECLINING)
    return near or any(relation_to(t, wanted) == "other" for kind, t in pair.clauses if kind in ("text", "item"))


def train(pairs: list[tuple[str | None, str]], rounds: int = 2, steps: int = 50) -> Field:
    """A field from the pairs that show no sign of a defect and from the defects made of them; those it still takes for
    defective are left out of a second round."""
    field = None
    pairs = [(q, c) for q, c in pairs if not _doubtful(q, c)]
    for _ in range(rounds):
        if field is not None:
            pairs = [(q, c) for q, c in pairs if coverage(field, q, c)[0] is None]
        field = Field.fit(with_made_defects(pairs), steps if field is not None or rounds == 1 else steps // 2)
    return field


class Field:
    """A linear-chain conditional random field over hashed features."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, pairs: list[Pair], steps: int = 80, rate: float = 0.08, decay: float = 1e-5, stretch: int = 64) -> Field:
        """Conditional likelihood by forward-backward on all sequences at once, with Adam's steps.

        A response of more than ``stretch`` clauses is trained on in stretches, one after the other.
        """
        L = len(LABELS)
        field = cls(np.zeros((BUCKETS, L)), np.zeros((L + 1, L)))
        runs = [(p.features[a : a + stretch], p.labels()[a : a + stretch]) for p in pairs for a in range(0, len(p.clauses), stretch)]
        if not runs:
            return field
        runs.sort(key=lambda r: -len(r[0]))  # so that the sequences that go on at a place come first
        length = np.array([len(f) for f, _ in runs])
        n, T = len(runs), length[0]
        live = [int((length > t).sum()) for t in range(T)]
        ids = np.concatenate([f for r, _ in runs for f, _ in r])
        value = np.concatenate([v for r, _ in runs for _, v in r])[:, None]
        widths = np.array([len(f) for r, _ in runs for f, _ in r])
        owner = np.repeat(np.arange(len(widths)), widths)
        begins = np.cumsum(widths) - widths
        row = np.repeat(np.arange(n), length)
        col = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        y = np.concatenate([labels for _, labels in runs])
        truth = np.zeros((len(y), L))
        truth[np.arange(len(y)), y] = 1
        before = np.where(col == 0, L, np.concatenate([[L], y[:-1]]))
        seen_moves = np.zeros((L + 1, L))
        np.add.at(seen_moves, (before, y), 1)
        first = {"w": 0.0, "m": 0.0}
        second = {"w": 0.0, "m": 0.0}
        for step_no in range(1, steps + 1):
            e = np.zeros((n, T, L))
            e[row, col] = np.add.reduceat(field.weights[ids] * value, begins, axis=0)
            A = field.moves[:L]
            forward, backward = np.zeros((n, T, L)), np.zeros((n, T, L))
            forward[:, 0] = e[:, 0] + field.moves[L]
            for t in range(1, T):
                k = live[t]
                forward[:k, t] = _logsum(forward[:k, t - 1, :, None] + A, 1) + e[:k, t]
            for t in range(T - 2, -1, -1):
                k = live[t + 1]
                backward[:k, t] = _logsum(A + (e[:k, t + 1] + backward[:k, t + 1])[:, None, :], 2)
            z = _logsum(forward[np.arange(n), length - 1], 1)
            expected = np.exp(forward + backward - z[:, None, None])[row, col]
            moves = np.zeros((L + 1, L))
            moves[L] = expected[col == 0].sum(axis=0)
            for t in range(1, T):
                k = live[t]
                joint = forward[:k, t - 1, :, None] + A + (e[:k, t] + backward[:k, t])[:, None, :] - z[:k, None, None]
                moves[:L] += np.exp(joint).sum(axis=0)
            miss = (truth - expected)[owner] * value
            gw = np.stack([np.bincount(ids, miss[:, l], BUCKETS) for l in range(L)], axis=1)
            gw = gw / n - decay * field.weights
            gm = (seen_moves - moves) / n - decay * field.moves
            for name, g, held in (("w", gw, field.weights), ("m", gm, field.moves)):
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g**2
                up = first[name] / (1 - 0.9**step_no) / (np.sqrt(second[name] / (1 - 0.99**step_no)) + 1e-7)
                held += rate * up
        return field

    def tags(self, pair: Pair) -> list[int]:
        """The most likely labels of a pair's clauses, by Viterbi."""
        L = len(LABELS)
        score, back = None, []
        for f, v in pair.features:
            e = v @ self.weights[f]
            if score is None:
                score = e + self.moves[L]
                continue
            total = score[:, None] + self.moves[:L]
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + e
        if score is None:
            return []
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def coverage(field: Field, query: str | None, content: str | None) -> tuple[str | None, list[float]]:
    """The defect of a pair, or None, and the share of the response's characters that each label covers."""
    if content is None or is_empty(content):
        return "empty", [0.0] * len(LABELS)
    pair = Pair(query, content)
    tags = field.tags(pair)
    held = np.zeros(len(LABELS))
    for tag, size in zip(tags, pair.size):
        held[tag] += size
    share = held / max(1.0, held.sum())
    if share[REFUSAL] > 0 and share[ANSWER] + share[UNFINISHED] <= 0.5 and share[FOREIGN] <= share[REFUSAL]:
        defect = "refusal"
    elif share[ECHO] >= 0.7:
        defect = "copied"
    elif share[FOREIGN] > 0.5:
        defect = "other_language"
    elif tags and tags[-1] == UNFINISHED and pair.ends[-1] in ("open", "cut"):  # the exact check of its end
        defect = "truncated"
    else:
        defect = None
    return defect, share.tolist()


def broken_pairs(
    df: DataFrame, id_col: str, query: str, content: str, sample_size: int = 3000, only_broken: bool = True
) -> DataFrame:
    """<id_col>, defect, and the share of each label: answer, refusal, echo, foreign, unfinished.

    defect is empty, refusal, copied, other_language, truncated or, unless only_broken, null. A null response is
    empty; a null or empty question has no language and can't be copied. Rows are judged one by one, so repeated
    rows repeat their result; a response is read whole, whatever its length. sample_size bounds the pairs, chosen
    by a hash of their id, that the field is trained on.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(query).alias("q"), F.col(content).alias("c"))
    chosen = slim.where(F.length("c") > 0).orderBy(F.xxhash64(F.col("id").cast("string")), "c").limit(sample_size).collect()
    field = train([(r["q"], r["c"]) for r in chosen if not is_empty(r["c"])])
    sent = df.sparkSession.sparkContext.broadcast(field)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = sent.value
        for batch in batches:
            judged = [coverage(field, q if isinstance(q, str) else None, c if isinstance(c, str) else None) for q, c in zip(batch["q"], batch["c"])]
            out = pd.DataFrame({"id": batch["id"], "defect": [d for d, _ in judged]})
            for i, label in enumerate(LABELS):
                out[label] = [s[i] for _, s in judged]
            yield out[out["defect"].notna()] if only_broken else out

    kind = slim.schema["id"].dataType.simpleString()
    shares = ", ".join(f"{label} double" for label in LABELS)
    return slim.mapInPandas(judge, f"id {kind}, defect string, {shares}").withColumnRenamed("id", id_col)
