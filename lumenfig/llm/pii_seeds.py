"""Made-up sentences with labelled mentions, on which the redaction models are fitted."""

from __future__ import annotations

import re

import numpy as np

#: Common given names, titles, street words, and cues around mentions.
GIVEN = (
    "Ada Alice Amir Ana Andrea Anika Anna Antonio Aria Ben Bruno Carla Carlos Carmen Chen Clara Daniel Dario David Diego Dieter Elena Elias Elif Emil Emma Erik Eva Fatima Felix Frank Greta Hana Hannah "
    "Hans Helena Henrik Hugo Ingrid Irene Isabel Ivan Jan Jana Javier Johan John Jonas Jorge Jose Juan Julia Karim Karin Katja Klaus Lars Laura Lea Leila Lena Leon Liam Linda Lucas Lucia Luis Luisa "
    "Marco Marcus Maria Marie Mario Marta Martin Mary Mateo Max Maya Mei Mia Miguel Mila Mohamed Nadia Nina Noah Noemi Nora Olga Oliver Omar Oscar Oskar Otto Pablo Paul Paula Pedro Peter Petra Rafael "
    "Rita Robert Rosa Ruben Samuel Sara Sarah Simon Sofia Sophie Stefan Susan Sven Tariq Teresa Thomas Tim Tom Tomas Ursula Vera Viktor Wei William Yara Yusuf Zoe"
).split()
TITLES = ["Dr.", "Prof.", "Mr.", "Mrs.", "Ms", "Ms.", "Mr", "Dr", "Herr", "Frau", "Sr.", "Sra."]
STREETS = ["Street", "Road", "Lane", "Avenue", "Ave.", "Crescent", "Drive", "Way", "Close", "Court", "Square", "Terrace", "St.", "Rd.", "Boulevard", "Hill"]

_START = "Mar Wil Kel Hal Tor Bel Far Gol Sel Jor Ul Nor Pel Bru Hart Lind Berg Stein Cor Dun Arm Ost Mon Val Ros Gar Her Fer Lor San Cas Del Wes Nort Ar Or Es Yar Zel Quin Lom Ras Vas Is".split()
_MID = "an el in on ar er or al en ski va lle gna bri tta dwi que pha mo rre sto che no ro di ska".split()
_END = "ez son sen berg mann ström ova ski qvist bury ford ley velt kamp tiago ricci dottir hoven worthen ado bach sard mond ini eau ton well wood field".split()
_CODE = "Vr Kr Dr Pl Gr St Tr Fl Br Sh Qu Th Z K T M L S P N D G B V R F".split()
_CODE_MID = "ax o i ua ee oi ie a u e ao io ea uu".split()
_CODE_END = "th x n st r l nix vek dor mis soe zan kef lum tan ova eth ium ine aust oor uis iida".split()


class Invented:
    """Random parts of sentences; the same seed gives the same texts."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.rng.integers(0, 10, n))

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def surname(self) -> str:
        s = self.pick(_START) + (self.pick(_MID) if self.chance(0.8) else "") + self.pick(_END)
        return f"{s}-{self.surname()}" if self.chance(0.07) else s

    def given(self) -> str:
        return self.pick(GIVEN) if self.chance(0.9) else (self.pick(_START) + self.pick(["a", "o", "i", "us", "ina"]))

    def person(self) -> str:
        g, s = self.given(), self.surname()
        form = self.rng.random()
        name = f"{g} {s}" if form < 0.5 else f"{s}, {g}" if form < 0.62 else f"{g[0]}. {s}" if form < 0.75 else f"{g} {chr(65 + int(self.rng.integers(26)))}. {s}" if form < 0.85 else f"{g} {s}".upper() if form < 0.91 else f"{self.pick(TITLES)} {g} {s}"
        return name

    def model(self) -> str:
        s = "".join(self.pick(_CODE) + self.pick(_CODE_MID) for _ in range(int(self.rng.integers(1, 3)))).capitalize() + self.pick(_CODE_END)
        form = self.rng.random()
        return s + (self.pick(["Net", "Bench", "Set", "Former", "Hub"]) if form < 0.25 else self.pick(["-7k", "-XL", "-2", "-B", "-Lite", "-v3", " 2"]) if form < 0.5 else "") if form < 0.9 else s.upper()

    def place(self) -> str:
        return (self.pick(_START) + self.pick(["mere", "wick", "ton", "brae", "hollow", "by", "den", "water", "lan", "sel", "field", "bach", "villa"])).capitalize()

    def street(self) -> str:
        return self.pick(["Oak", "Elm", "Birch", "Cedar", "Maple", "Hazel", "Rowan", "Willow", "Larch", "Holly", "Church", "Mill", "Station", "Park", "Alder", "Juniper", "Bramble", "Thistle", "Hawthorn", "Gorse", "Nettle", "Foxglove"])

    def address(self) -> str:
        n, s, p, z = str(self.rng.integers(1, 400)), self.street(), self.place(), self.digits(5)
        if self.chance(0.12):
            n += self.pick("ABC")
        form = int(self.rng.integers(13))
        join = self.pick([", ", ", ", " ", "\n", ",\n"])
        return [
            f"{n} {s} {self.pick(STREETS)}{join}{p}", f"{n} {s} {self.pick(STREETS)}{join}{p} {z}", f"Flat {self.rng.integers(1, 40)}, {n} {s} {self.pick(STREETS)}{join}{p}", f"{n} {s} {self.pick(STREETS)}, Apt {self.rng.integers(1, 90)}, {p} {z}",
            f"{s} Crescent {n}, {p}", f"P.O. Box {self.rng.integers(1, 9999)}, {p} {z}", f"PO Box {self.rng.integers(1, 9999)}, {p}", f"Calle {s} {n}, {self.rng.integers(1, 6)}.º {self.pick('ABC')}, {z} {p}", f"Avda. de {s}, nº {n}, {p}",
            f"Plaza {s} {n}, {z} {p}", f"{s}straße {n}, {z} {p}", f"{s}str. {n}, {z} {p}", f"Am {s} {n}, {z} {p}",
        ][form]

    def phone(self) -> str:
        a, b, c, d = self.digits(3), self.digits(3), self.digits(4), self.digits(2)
        form = int(self.rng.integers(15))
        return [
            f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b}-{c}", f"+1{a}{b}{c}", f"+1 {a} {b} {c}", f"+44 7{a} {b}{a}", f"07{a} {b}{a}", f"0044 7{a} {b}{a}", f"+44 (0)7{a} {b} {a}", f"{b}-{c} ext. {d}",
            f"+{self.rng.integers(30, 999)} {a} {d} {self.digits(2)} {self.digits(2)}", f"+49 {a} {self.digits(6)}", f"0{a} {self.digits(7)}", f"+34 {a} {b} {a}", f"{b}-{c}",
        ][form]

    def number(self) -> str:
        d = self.digits
        cap = self.pick("ABCDEFGHKLMNPRSTUVWXYZ")
        form = int(self.rng.integers(14))
        return [
            f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"X{d(7)}-{cap}", f"{d(8)}{cap}", f"{cap}{d(7)}", f"{cap}{cap}{d(7)}", f"{cap}{cap} {d(2)} {d(2)} {d(3)}", f"{cap}{cap} {d(2)} {d(2)} {d(2)} {self.pick('ABCD')}", f"ID-{d(6)}/{d(3)}", f"{d(2)}.{d(3)}.{d(3)}-{d(2)}",
            f"{d(9)}", f"{d(2)}.{d(3)}.{d(3)}-{self.pick('0123456789K')}", f"{cap}{d(8)}", f"{d(6)}-{d(4)}",
        ][form]

    def email(self) -> str:
        g, s = self.given().lower(), re.sub(r"\W", "", self.surname()).lower()
        user = self.pick([f"{g}.{s}", f"{g[0]}.{s}", f"{g}{s}", f"{g}_{s}", f"{g}-{s}", f"{g[0]}{s}"]) + self.pick(["", "", self.digits(2), "+lab", "+figs"])
        host = [self.pick(["mail", "uni", "lab", "vision-lab", "web", "docs-team", "optics", "data"]), self.pick(["example", "university", "institute", "company"]), *self.pick([["com"], ["org"], ["net"], ["test"], ["de"], ["es"], []])]
        at, dot = self.pick([("@", "."), ("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" AT ", " DOT "), (" at ", " dot "), ("(at)", "(dot)")])
        out = user + at + dot.join(host)
        return out.upper() if self.chance(0.06) else out


#: Made-up sentences; {p} is a person, {m} an e-mail address, {t} a telephone number, {i} an identity number, {a} an address; {x} a model, {n} a number.
WITH = [
    "We thank {p} for labelling the images.", "Thanks go to {p} for proofreading.", "My colleague {p} rescanned the page.", "My neighbour {p} called yesterday.", "The drawing comes from {p}, who kept the original.", "Sketch drawn by {p} last spring.", "According to {p}, who kept the notes, the axis was flipped.",
    "The form was signed by {p}, identity no. {i}, on page two.", "The waiver of volunteer {p} (passport no. {i}) was filed twice.", "Patient {p}, national id {i}, agreed.", "Staff payroll no. {i} is written beside the stamp.", "Payroll number {i} belongs to {p}.", "The badge shows staff number {i}.", "Her passport {i} was copied by mistake.", "Social security number {i} is visible on the scan.",
    "Visitor card: {p}; tel. {t}; mail {m}; id {i}.", "Name: {p}, tel. {t}, e-mail {m}.", "Contact: {m} or {t}.", "Contact: {p}, {m}.", "Questions about the data go to {p} ({m}).", "Write to {m} for the missing files.", "Mail {m} for a copy.", "Call {t} if the page stalls.", "Please phone {t} before noon.", "Corresponding author: {p}, {a}, tel. {t}.",
    "Please post the slides to {p}, {a}.", "Send the prints to {p}, {a}.", "A paper version is kept at {a}.", "Visitors come to {a}.", "{p} lives at {a}.", "He moved to {a} last year.", "Contacto: {p}, {a}, tel. {t}.", "Autor de contacto: {p}, {a}.", "Su correo es {m}.", "Las preguntas se envían a {p} ({m}).", "Llame al {t} o pase por {a}.", "En la hoja figura el DNI {i} de {p}.", "El pasaporte {i} de {p} fue escaneado.",
    "Damos las gracias a {p} por revisar el texto.", "Agradecemos a {p} su ayuda.", "Kontakt: {p}, {a}, Tel. {t}.", "Rückfragen an {p} ({m}).", "Wir danken {p} für die Durchsicht der Bilder.", "Anruf unter {t} möglich.", "Die Ausweisnummer {i} von {p} war lesbar.", "Die Personalnummer {i} gehört {p}.", "The interview with {p} was not recorded.", "{p} asked for a second scan.", "Photo taken by {p}.", "In the margin {p} wrote a comment.", "Note from {p}: check the legend.",
    "Wohnhaft in {a}.", "Die Unterlagen gehen an {a}.", "Besuch nach Absprache: {a}.", "{p} wohnt jetzt {a}.", "Adresse: {a}, Tel. {t}.", "Name on the card: {p}; phone {t}.", "Sheet filled in by {p}, document {i}.", "Please ring {t} when the viewer hangs.",
]
WITHOUT = [
    "{x} and {x} begin with the title.", "Both {x} and {x} use the same encoder.", "Since {x} reuses a block of {x}, the curves touch near {n}.", "Without {x} the error goes down.", "For {x} we report recall and the size of the cache.", "Unlike {x}, the small sampler keeps no state.", "As table {n} records, {x} spends most of its budget on pages.", "Titles were indexed by {x}, and pages by {x}.", "{x} {x} were compared with {x}.",
    "We list precision@{n}, recall@{n} and ndcg@{n} for {x}.", "In the code @{x} is a decorator.", "The release of {x} has doi 10.{d4}/data.{d7}.{d2}.", "Funding code RX-20{d2}-{d3}-{d2} paid for it.", "Grant number {d3}-{d6} paid for it.", "Run 20{d2}-{d2}-{d3} logged {d7} steps on {x}.", "The pattern {d3} {d3} {d2} comes back in the {x} trace.", "The build {d1}.{d2}.{d3}-rc{d1} of {x} was used.", "Its weights are {d3}x{d2}x{d1}, or {d7} values.", "Box {d2} stands for the {x} part.", "Box {d1} shows the {x} module.", "Street views in {x} show {d3} lanes and {d2} avenues.",
    "Street scenes and road signs from {x} were cropped.", "The {x} Road data set has {d4} images.", "Figure {d2} shows the {x} loss over {d4} updates.", "Between epochs {d3} and {d4} the {x} layer is frozen.", "A check of {d4} crops by hand showed one bad legend.", "We trained {x} on {d5} images with seed {d3}.", "Cell {d2}-{d2}-{d4} of the grid is empty.", "Version {d1}.{d1}.{d2} of {x} fixed it.", "The checksum is {d8}.", "Accession {d8} belongs to {x}.", "Part number {d3}-{d3}-{d4} of the sensor was replaced.", "ISBN {d3}-{d1}-{d4}-{d4}-{d1} lists it.",
    "En cada fila {x} se mide contra {x} con {d3} semillas.", "La figura {d3} muestra cómo {x} mejora frente a {x}.", "Los autores de este trabajo atribuyen la caída a {x}.", "Abbildung {d2} zeigt, wie {x} die Varianz ändert.", "Das Modell {x} wurde mit {d3} Bildern trainiert.", "In jeder Zeile steht {x} neben {x} mit {d3} Werten.", "Rank {x}, {x} and {x} by loss.", "Someone picks two crops from {x} and hides the labels.", "Imagine that just one trace of {x} is left; was it {x} or {x}?", "The right answer names {x}, which holds {d3} samples.",
    "Bayes factors and Gaussian noise were used in {x}.", "The Markov chain of {x} mixes fast.", "Los Angeles and New York images are in {x}.", "The Vision Group at the University runs {x}.", "Table {d1} and Appendix B list {x}.", "GPU {d1} ran {x} at {d4} samples per second, {d3}.{d2} ms each.", "Note that the band of {x} spans {d4} seeds.", "No part of {x} looks at the order of pages.", "Our model retrieves the figure in {d4} of {d4} queries when {x} helps.", "Scans are {d4} x {d4} pixels, {d3} dpi.",
    "The table gives hit@{n} and map@{n} per model.", "At recall@{n} both {x} and {x} agree.", "We score {x} by precision@{n} only.", "Its ndcg@{n} and mrr@{n} fall when {x} is cut.", "Top hits of {x} at precision@{n} were read by hand.", "The decorator @{x} wraps the call.",
    "Loss falls against {x} Given more seeds it stays.", "Put {x} first When both agree the tie is kept.", "Gains over {x} Full tables follow.", "Order {x} Rank the rest by loss.", "{x}, {x} and {x} come in that order.", "the of {x} {x} by shuffled words {x}, then {n} more.", "Scores of {x} Between runs they drift.", "It drops next to {x}\n\nEarlier plots hid this.", "{x} An extra run of {x} helped.", "It is close to {x} Both were run twice.",
    "Box {d2} in the chart is the {x} step.", "In box {d1} of the scheme {x} starts.", "Box {d1} feeds box {d2}.", "Its {d3} lanes and {d1} avenues are labelled by {x}.", "Of {d2} roads and {d3} streets {x} finds most.",
]


def labelled(n: int, seed: int, held: bool = False) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n texts of a few sentences, each with its mentions (kind, start, end). held: from every fifth sentence, which the others never use."""
    having, lacking = ([p for i, p in enumerate(plans) if (i % 5 == 4) == held] for plans in (WITH, WITHOUT))
    made = Invented(seed)
    say = {"p": ("person", made.person), "m": ("email", made.email), "t": ("phone", made.phone), "i": ("id_number", made.number), "a": ("address", made.address)}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(made.rng.integers(1, 5))):
            text += made.pick(["", " ", "", "\n"]) if text else ""
            plan, loud = (made.pick(having), False) if made.chance(0.5) else (made.pick(lacking), made.chance(0.1))
            for piece in re.split(r"(\{\w+\})", plan):
                key = piece[1:-1] if piece[:1] == "{" else ""
                if key in say:
                    kind, draw = say[key]
                    value = draw()
                    spans.append((kind, len(text), len(text) + len(value)))
                    text += value
                else:
                    said = made.model() if key == "x" else str(made.rng.integers(1, 9999)) if key == "n" else made.digits(int(key[1:])) if key[:1] == "d" else piece
                    text += said.upper() if loud else said
            text += " "
        out.append((text.rstrip(), spans))
    return out
