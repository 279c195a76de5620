"""Mentions of private persons and of how to reach or identify them, replaced by their kind.

High-recall generators propose spans, which may overlap: patterns for e-mail addresses (written out ones too), runs of
digits, street and box forms of three languages, and pairs of capitalised words. Each proposal becomes a row of
features of its format and of the words around it, and boosted trees, one model per kind, give its chance. The
thresholds are calibrated on held-out rows. Of overlapping accepted spans the one furthest above its threshold stays.

The models are fitted on ``fitted`` made-up labelled texts and calibrated on others of sentences they have not seen, a bounded sample; they are small and go to the tasks by
broadcast. Null and empty texts have no mentions. Texts are read whole; repeated texts are each treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfig.llm.boosting import Boosted
from lumenfig.llm.pii_seeds import GIVEN, STREETS, TITLES, labelled

KINDS = ["person", "email", "phone", "id_number", "address"]

_EMAIL = re.compile(
    r"(?<![\w.+-])\w[\w.+-]*(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?|\sat\s)[a-z][\w-]*(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)[a-z][\w-]*)+|(?<![\w.+-])\w[\w.+-]*@[\w-]+", re.I
)
_NUMBER = re.compile(r"(?<![\w.@/])(?:[A-Z]{1,3}[- ]?)?[+(]{0,2}\d[\d\s().\-/]{4,}[\d)](?:[- ]?[A-Z](?!\w))?(?:\s*(?:ext|x|Durchwahl)\.?\s*\d+)?")
_ROADS = "|".join(re.escape(s) for s in STREETS)
_PLACE = r"(?:,?\s+(?:\d{4,5}\s+)?[A-ZÀ-Þ][\w-]+(?:\s+\d{4,5})?)?"
_ADDRESS = re.compile(
    rf"(?:Flat\s+\d+,\s*)?\d+[A-Z]?\s+(?:[A-ZÀ-Þ][\w'-]+\s+){{1,3}}(?:{_ROADS})(?!\w)(?:,?\s*Apt\.?\s*\d+)?{_PLACE}"
    rf"|[A-ZÀ-Þ][\w'-]+\s+(?:{_ROADS})\s+\d+[A-Z]?(?!\w){_PLACE}"
    rf"|(?:P\.?\s?O\.?\s?)?Box\s+\d+{_PLACE}"
    rf"|(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo)\s+(?:de\s+|del\s+)?[A-ZÀ-Þ][\w'-]+,?\s+(?:n[º°.]?\s*)?\d+(?:,\s*\d+\.?[ºª]?\s*[A-Z])?{_PLACE}"
    rf"|[A-ZÀ-Þ]\w*(?:straße|strasse|str\.|weg|platz|allee|gasse)\s+\d+[a-z]?(?!\w){_PLACE}"
    rf"|(?:Am|Im|Zum|An der|Auf der)\s+[A-ZÀ-Þ]\w+\s+\d+[a-z]?(?!\w){_PLACE}"
    rf"|\d+[A-Z]?\s+(?:[a-z]+\s+)?(?:lanes|roads|avenues|streets)"
)
# Whatever a pattern above finds holds what its gate looks for, and gates are quick: most texts pass none.
_EMAIL_GATE = re.compile(r"@|\(at\)|\[at\]|\sat\s[a-z][\w-]*(?:\.[a-z]|\s?\(dot|\s?\[dot|\sdot\s)", re.I)
_NUMBER_GATE = re.compile(r"\d[\d\s().\-/]{4,}[\d)]")
_ADDRESS_GATE = re.compile(
    rf"\s(?:{_ROADS})(?!\w)|Box\s+\d|Calle|C/|Avda\.|Avenida|Plaza|Paseo|(?:straße|strasse|str\.|weg|platz|allee|gasse)\s+\d|(?:Am|Im|Zum|An der|Auf der)\s+[A-ZÀ-Þ]\w+\s+\d|lanes|roads|avenues|streets"
)
_CAPITAL = re.compile(r"[A-ZÀ-Þ](?:\.(?=\s)|[\w'’]*(?:-[A-ZÀ-Þ0-9][\w'’]*)*)")
_WORD = re.compile(r"[^\W_]+")

#: Words that hint at a kind of mention, or at something else.
_CUES = {
    "reach": "call phone tel telephone mobile fax llamar telefonisch teléfono telefon erreichbar ring dial",
    "proof": "passport identity id payroll document ausweisnummer ausweis documento pasaporte national security social staff badge personalnummer license dni nif nie number no",
    "post": "ship send lives copies visitors moved acudir address requested plates prints wohnt dirección",
    "mail": "mail email write contact kontakt correo escriba fragen questions contacto",
    "human": "thank thanks signed participant colleague neighbour patient author autora autor reviewer name drawn made taken according danken agradece agradecemos belongs gehört interview photo note formulario scan annotator sketch figure",
    "act": "who asked wrote called rescanned during lives kept für for la su was himself herself born margin last",
    "code": "doi grant run sequence build version tensor shape seed seeds epochs epoch steps entries gpu isbn accession checksum part cell box grid resolution samples archive logged logs code",
    "study": "model data set split band trace panel layer encoder table captions images between since both against versus rank models crops compares trained with",
    "to": "to by of from an von de a den",
}
_CUE_SETS = [frozenset(v.split()) for v in _CUES.values()]
#: Words that open sentences and are no names.
_OPENERS = frozenset(
    "the a an this that these those we our when since both in for as no nothing between if it its he she they readers captions figure figures table manual two questions earlier cropping suppose rank given full "
    "an see run box main box la el los las en cada se para puede das der die jede abbildung im wir am fragen contact kontakt write call ship send printed retrieval sequence grant annotator corresponding reviewer appendix "
    "section version part not and or of with to from by on at calle plaza avda apt flat los new united".split()
)
_GIVEN = frozenset(g.lower() for g in GIVEN)
_TITLES = frozenset(t.rstrip(".").lower() for t in TITLES)
_ROAD_WORDS = frozenset(s.rstrip(".").lower() for s in STREETS) | {"box", "calle", "plaza", "avda", "flat", "apt"}


def _around(text: str, start: int, end: int) -> list[float]:
    left = [w.lower() for w in _WORD.findall(text[max(0, start - 60) : start])][-6:]
    right = [w.lower() for w in _WORD.findall(text[end : end + 40])][:3]
    near, far, after = set(left[-2:]), set(left), set(right)
    out = [float(bool(cue & x)) for cue in _CUE_SETS for x in (near, far, after)]
    before = text[max(0, start - 2) : start].strip()[-1:]
    return out + [float(before == c) for c in ".:(,;@"] + [float(before == "" and start == 0), float(text[end : end + 1] in ",;("), float(text[end : end + 1] == ".")]


def _number_row(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    groups = [len(g) for g in re.findall(r"\d+", s)]
    lead = len(re.match(r"[A-Z]*", s)[0])
    first = re.search(r"\d+", s)[0]
    return [
        float(sum(groups)), float(len(groups)), *[float(g) for g in (groups + [0] * 5)[:5]], float(lead), float(bool(re.search(r"[A-Z]$", s))), float("+" in s), float(first.startswith("00")), float(first.startswith("0")), float(first.startswith("555")), float("555" in groups or "555" in s),
        float("(" in s), float(s.count(".")), float(s.count("-")), float(s.count(" ")), float("/" in s), float("ext" in s), float(len(s)), float("\n" in s), float(first[:2] in ("19", "20")),
    ]


def _email_row(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    user, _, host = re.split(r"(@|\(at\)|\[at\]|\sat\s)", s, maxsplit=1, flags=re.I) if re.search(r"@|\(at\)|\[at\]|\sat\s", s, re.I) else (s, "", "")
    return [float(len(s)), float(len(user)), float(host.count(".")), float("dot" in host.lower()), float("@" in s), float(" " in s), float(host.strip()[:1].isdigit()), float(bool(re.search(r"[._+-]", user))), float(user.lower() in ("precision", "recall", "map", "ndcg", "hit")), float(host.strip().isdigit())]


def _address_row(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    return [
        float(len(s)), float(len(re.findall(r"\d+", s))), float(bool(re.search(r"\d{5}", s))), float(bool(re.match(r"P\.?\s?O", s))), float(bool(re.match(r"Box", s))), float(s[:1].isdigit()), float(bool(re.search(rf"(?:{_ROADS})(?!\w)", s))), float("," in s), float(bool(re.search(r"straße|strasse|str\.|weg|platz|allee|gasse", s))),
        float(bool(re.match(r"Calle|C/|Avda|Avenida|Plaza|Paseo", s))), float(bool(re.match(r"Am|Im|Zum|An|Auf", s))), float(bool(re.search(r"(?:lanes|roads|avenues|streets)$", s))), float(sum(w[:1].isupper() for w in s.split())), float("\n" in s),
    ]


def _odd(word: str) -> bool:
    """Does a word look like a model's or data set's name: digits, inner capitals, or a code after a hyphen?"""
    return any(c.isdigit() for c in word) or (not word.isupper() and any(c.isupper() for p in re.split(r"[-'’]", word) for c in p[1:])) or bool(re.search(r"-(?:[A-Z]{1,2}|Lite|Large|Base|Small|Tiny)$", word))


def _person_row(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    names = [w.rstrip(".") for w in re.split(r"[\s,]+", s)]
    titled = names[0].lower() in _TITLES
    core = names[1:] if titled else names
    first, last = (core[0], core[-1]) if core else ("", "")
    comma, endings = "," in s, ("net", "bench", "set", "former", "hub")
    return [
        float(len(core)), float(titled), float(first.lower() in _GIVEN), float(last.lower() in _GIVEN), float(comma), float(len(first) == 1), float(any(len(w) == 1 for w in core[1:])), float(s.isupper()), float(len(first)), float(len(last)), float(_odd(first)), float(_odd(last)), float(first.lower() in _OPENERS), float(last.lower() in _OPENERS),
        float(last.lower().endswith(endings)), float(first.lower().endswith(endings)), float(any(w.lower() in _ROAD_WORDS or re.search("straße$|str$", w.lower()) for w in core)), float("\n" in s), float(first.isupper() and len(first) > 1), float(last.isupper() and len(last) > 1), float("-" in last), float(bool(re.search(r"[.!?]\s*$", text[max(0, start - 2) : start])) or start == 0),
    ]


def _people(text: str) -> Iterator[tuple[int, int]]:
    """Two or three capitalised words beside each other, one of them maybe an initial, in either order, with a title or not."""
    found = [m.span() for m in _CAPITAL.finditer(text) if m.end() - m.start() > 1 or not text[m.end() : m.end() + 1].isalnum()]
    for i, (a, b) in enumerate(found):
        if a and (text[a - 1].isalnum() or text[a - 1] in "@_-."):
            continue
        titled = text[a:b].lower() in _TITLES or text[a:b].rstrip(".").lower() in _TITLES
        j, parts, commas = i, 1, 0
        while j + 1 < len(found) and parts < 3 + titled:
            gap = text[found[j][1] : found[j + 1][0]]
            if gap.startswith(".") and titled and j == i:
                gap = gap[1:]
            if gap in (", ", ",\n") and not commas and parts < 2 + titled:
                commas = 1
            elif not gap or gap.strip() or len(gap) > 3:
                break
            j += 1
            parts += 1
            if parts - titled >= 2 and (found[j][1] - found[j][0] > 2 or text[found[j][0] + 1 : found[j][1]] not in ("", ".")):
                yield a, found[j][1]


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """(generator, start, end) of all candidates."""
    for m in _EMAIL.finditer(text) if _EMAIL_GATE.search(text) else ():
        yield "email", *m.span()
    for m in _NUMBER.finditer(text) if _NUMBER_GATE.search(text) else ():
        s = m[0].rstrip(" \n(.-/")
        n = sum(c.isdigit() for c in s)
        if n >= 7 or n == 6 and s[0].isalpha():
            yield "number", m.start(), m.start() + len(s)
            tail = re.search(r"[- ]?[A-Z]$", s)
            if tail and s[-2] == " ":
                yield "number", m.start(), m.start() + tail.start()
    for m in _ADDRESS.finditer(text) if _ADDRESS_GATE.search(text) else ():
        yield "address", *m.span()
    for a, b in _people(text):
        yield "person", a, b


_ROWS = {"email": _email_row, "number": _number_row, "address": _address_row, "person": _person_row}
_MODELS = {"email": ["email"], "number": ["phone", "id_number"], "address": ["address"], "person": ["person"]}


@cache
def fit(fitted: int = 6000, seed: int = 3) -> dict[str, Boosted]:
    """The models of all kinds, fitted on made-up texts; a quarter as many, of other sentences, calibrate the thresholds."""
    rows: dict[str, list[list[float]]] = {g: [] for g in _ROWS}
    apart: dict[str, list[bool]] = {g: [] for g in _ROWS}
    said: dict[str, list[int]] = {k: [] for k in KINDS}
    for held, texts in ((False, labelled(fitted, seed)), (True, labelled(fitted // 4, seed + 1, True))):
        for text, spans in texts:
            for g, a, b in proposals(text):
                rows[g].append(_ROWS[g](text, a, b) + _around(text, a, b))
                apart[g].append(held)
                for kind in _MODELS[g]:
                    over = max((max(0, min(b, d) - max(a, c)) / (max(b, d) - min(a, c)) for k, c, d in spans if k == kind), default=0.0)
                    said[kind].append(int(over >= 0.7))
    return {kind: Boosted().fit(np.array(rows[g]), np.array(said[kind]), np.array(apart[g])) for g, kinds in _MODELS.items() for kind in kinds}


def mentions(texts: list[str], models: dict[str, Boosted]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) per text, in order, not overlapping."""
    at: dict[str, list[tuple[int, int, int]]] = {g: [] for g in _ROWS}
    rows: dict[str, list[list[float]]] = {g: [] for g in _ROWS}
    for i, text in enumerate(texts):
        for g, a, b in proposals(text or ""):
            at[g].append((i, a, b))
            rows[g].append(_ROWS[g](text, a, b) + _around(text, a, b))
    accepted: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    for g, kinds in _MODELS.items():
        if not rows[g]:
            continue
        x = np.array(rows[g])
        for kind in kinds:
            margin = models[kind].chance(x) - models[kind].threshold
            for j in np.flatnonzero(margin >= 0).tolist():
                i, a, b = at[g][j]
                accepted[i].append((float(margin[j]) / (1 - models[kind].threshold), kind, a, b))
    out = []
    for found in accepted:
        taken: list[tuple[str, int, int]] = []
        for _, kind, a, b in sorted(found, key=lambda f: (-f[0], f[2] - f[3], f[2])):
            if all(b <= c or a >= d for _, c, d in taken):
                taken.append((kind, a, b))
        out.append(sorted(taken, key=lambda t: t[1]))
    return out


def redacted(df: DataFrame, key: str, text: str, fitted: int = 6000) -> DataFrame:
    """(key, text, kinds): each text with its mentions replaced by placeholders, and the kinds it mentions."""
    held = df.sparkSession.sparkContext.broadcast(fit(fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            clean, kinds = [], []
            for t, found in zip(texts, mentions(texts, held.value)):
                for kind, a, b in reversed(found):
                    t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
                clean.append(t)
                kinds.append(sorted({k for k, _, _ in found}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["key", "text", "kinds"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, text STRING, kinds ARRAY<STRING>")
