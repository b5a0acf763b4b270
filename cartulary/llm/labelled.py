"""Labelled sentences for the training of the field: made by rule, from invented words.

Every sentence is built from a frame with slots; what fills a slot is labelled or, for numbers
of files, amounts, dates, addresses of pages and bare initials, is not. Names are drawn half
from the list of given names and half from invented syllables, so that the weights do not rest
on the list; words around the slots are drawn as well.
"""

from __future__ import annotations

from random import Random

#: Texts made for the training: the bound of its sample.
SENTENCES = 6000

_ONSETS = "b br c cr d f fr g gr l m n p pr r s sc sp st t tr v z".split()
_VOWELS = "a e i o u ia ie io".split()
_CODAS = ["", "", "", "l", "n", "r", "s"]
_ENDINGS = "ini etti oni ari ello acci ucci ese aldi otti uso anzi".split()
_DOUBLES = "bb cc dd ff gg ll mm nn pp rr ss tt zz".split()

#: Frames: slots in braces; {w} is any word in small letters, {S} a whole plain sentence.
FRAMES = [
    "{S} Il {w} {N}, nato altrove, chiede {w}.", "{S} Sentito {N}, il {w} decide.", "L'avv. {N} deposita la {w}.", "La dott.ssa {N} riferisce; {N} tace.", "{N} si oppone al {w}.", "Compare {N} con {N} e {N}.", "Relatore {N}; segretario {N}.",
    "Nota di {N} del {date}.", "Il minore {N}, figlio di {N}, {w}.", "Istanza della sig.ra {N} ({D}).", "Consegnare a {N}, {A}.", "Delegato {N}.", "Visto: {N}", "Difensore di fiducia: {N} (tel. {T}).", "Si procede contro {N} e {N}.", "{N} - {D} - posizione {num}.",
    "Posta: {E}.", "Scrivere a {E} oppure {E}.", "Dal conto {E} in data {date} risulta {w}.", "Recapiti: {E}; {T}; {A}.", "Telefonare al {T} dopo le ore {h}.", "Tel. {T}", "Cell. {T}, fax {T}.", "Il numero è {T}.", "Utenza {T} spenta.", "Per informazioni: {T} / {E}.", "Chiami il {T}.",
    "C.F. {D}.", "Il documento {D} è scaduto.", "Passaporto n. {D} rilasciato a {N}.", "Carta d'identità {D} di {N}.", "Tessera {D} smarrita.", "Titolare del permesso {D}, {N} {w}.", "{D} ({N}).", "Codice fiscale: {D}", "CUI {D} e passaporto {D}.",
    "Abita in {A}.", "Residente in {A}, {N} {w}.", "Sede: {A}.", "Notificato presso {A} a mani di {N}.", "Domiciliata in {A}; {w}.", "Da {A} a {A}, entro il {date}.", "Ufficio di {A}, piano {h}.", "Si trova, scala {I1}, in {A} da tempo.",
    "{S} Prot. n. {num} del {date}.", "Fascicolo {num}, busta {h}.", "R.G. n. {num}/{year}.", "Iscritta al numero {num} del registro.", "Importo di euro {money} dal {date}.", "Scheda {url}.", "Consultare {url} alla pagina {h}.", "La sig.ra {I} non risponde.", "Il {w} {I} insiste.", "Lotto {lot}, turno {h}.", "Pratica {lot} chiusa.",
    "Segno @{lot} sul foglio.", "In via {w} si dispone {w}.", "Sul corso della {w}, pag. {h}, nulla.", "La piazza {w} al valico {h} è chiusa.", "Capi da {h} a {h}, art. {h}.", "Il {w} è [omissis].", "Tribunale di {P}, {w} del {date}.", "Il Ministero della {P} e la Corte di {P} {w}.", "Il Comune di {P} ordina.", "{S} {S}",
    "Raggiungibile al numero {T}.", "Contattare il numero {T} entro il {date}.", "Risponde al numero {T}; {w}.", "Chiama il {T} la sera.", "Chiama {T} ore {w}.", "Chiamare {T} per {w}.", "Numero utile: {T}", "{S} Nota inviata il {date} da {E}.", "Termine fissato al {date}; lettera del {date} di {N}.", "Codice fiscale {D}. Nei confronti di {N} il {w}.", "Documento {D}. Alla {w} {N} {w}.", "{D}. Un {w} e {N}.",
    "La Prefettura {w} il {w}. {N} {w}.", "Ricorso n. {num} di {N}.", "Mediatrice {N} di turno.", "Firma {N}", "{w}: {N}, {T}.", "Rif. {num} / {lot}.", "Sono comparsi personalmente {N}, assistito da {N}, e {N}.", "Per {N} si rinvia.", "Poi {N} rinuncia.",
]


class Maker:
    def __init__(self, seed: int, given: list[str]) -> None:
        self.r, self.given = Random(seed), given

    def pick(self, xs):
        return xs[self.r.randrange(len(xs))]

    def syllables(self, n: int) -> str:
        return "".join(self.pick(_ONSETS) + self.pick(_VOWELS) + self.pick(_CODAS) for _ in range(n))

    def word(self) -> str:
        return self.syllables(self.r.choice([1, 2, 2, 3])) + self.pick(["o", "a", "e", "ale", "ione", "ente", "ato"])

    def family(self) -> str:
        x = self.syllables(self.r.choice([1, 2])) + (self.pick(_DOUBLES) if self.r.random() < 0.3 else "") + self.pick(_ENDINGS)
        x = x.capitalize()
        if self.r.random() < 0.15:
            x = self.pick(["D'", "D’", "De ", "Di ", "El ", "Al-", "Ben ", "Della "]) + x
        return x

    def first(self) -> str:
        one = lambda: self.pick(self.given).capitalize() if self.r.random() < 0.5 else self.syllables(2).capitalize() + self.pick("aoe")
        x = one()
        if self.r.random() < 0.15:
            x += self.pick([" ", "-"]) + one()
        return x

    def name(self) -> str:
        a, b = self.first(), self.family()
        kind = self.r.random()
        if kind < 0.5:
            x = f"{a} {b}"
        elif kind < 0.7:
            x = f"{b} {a}"
        elif kind < 0.85:
            x = f"{a[0]}. {b}"
        elif kind < 0.93:
            x = f"{a} {b.upper()}"
        else:
            x = f"{b.upper()} {a}"
        style = self.r.random()
        if style < (0.2 if 0.7 <= kind < 0.85 else 0.08) and (0.7 <= kind < 0.85 or a.split()[0].split("-")[0].lower() in self.given):
            return x.lower()
        return x.upper() if style > 0.96 else x

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def phone(self) -> str:
        sep = self.pick([" ", ".", "-", "/", ""])
        if self.r.random() < 0.6:
            body = "3" + self.digits(2) + sep + self.digits(3) + self.pick([sep, " ", ""]) + self.digits(self.r.choice([3, 4]))
        else:
            body = "0" + self.digits(self.r.choice([1, 2, 3])) + self.pick([" ", "/", "-"]) + self.digits(self.r.choice([5, 6, 7]))
        return self.pick(["+39 ", "+39", "0039 ", ""] + [""] * 3) + body if self.r.random() < 0.95 else f"+{self.pick(['49', '33', '216', '234'])} {self.digits(3)} {self.digits(6)}"

    def document(self) -> str:
        L = lambda n: "".join(self.pick("ABCDEFGHILMNOPQRSTUVZ") for _ in range(n))  # noqa: E731, N806
        gap = self.pick(["", "", " "])
        kind = self.r.random()
        if kind < 0.4:
            x = gap.join([L(3), L(3), self.digits(2) + L(1) + self.digits(2), self.pick("LZFH") + self.digits(3) + (gap and self.pick(["", gap])) + L(1)])
        else:
            x = self.pick([L(2) + gap + self.digits(7), L(2) + self.digits(5) + L(2), L(1) + self.digits(8), L(2) + gap + self.digits(6), self.digits(2) + L(2) + self.digits(3) + L(1), "0" + self.digits(6) + L(1)])
        return x.lower() if self.r.random() < 0.15 and kind < 0.4 else x

    def mail(self) -> str:
        local = self.pick(["", "studio.", "avv-"]) + self.family().split("'")[-1].replace(" ", "").replace("’", "").lower() + self.pick(["", "_", "."]) + self.pick([self.first().split()[0].lower(), self.digits(2), ""])
        local = local.rstrip("._") or "posta"
        host = ".".join(self.syllables(2) for _ in range(self.r.choice([1, 1, 2])))
        end = self.pick(["example", "test", "invalid"])
        style = self.r.random()
        if style < 0.75:
            return f"{local}@{host}.{end}"
        if style < 0.85:
            return f"{local} [at] {host} [dot] {end}".replace("[at]", self.pick(["[at]", "(at)", "[chiocciola]"])).replace("[dot]", self.pick(["[dot]", "(dot)", "[punto]"]))
        return f"{local}{self.pick([' chiocciola ', ' at ', '(at)', ' @ '])}{host}.{end}"

    def street(self) -> str:
        way = self.pick(["via", "Via", "viale", "V.le", "piazza", "P.zza", "corso", "c.so", "largo", "vicolo", "VIA", "v.", "strada"])
        many = lambda: " ".join(self.family() for _ in range(self.r.choice([1, 1, 2])))
        name = self.pick(["", "", "", "dei ", "della ", "San "]) + many()
        number = str(self.r.randrange(1, 250)) + self.pick(["", "", "", "/A", "/b", " bis", " ter", "A"])
        number = self.pick([number] * 6 + ["snc", "s.n.c.", "s.n."])
        return f"{way} {name}{self.pick([', ', ' ', ', n. ', ' n° ', ', civ. '])}{number}"

    def filler(self, slot: str) -> str:
        r = self.r
        sep, pad = self.pick("./-"), self.pick(["", "0"])
        date = f"{r.randrange(1, 29):{pad}{2 if pad else ''}}{sep}{r.randrange(1, 13):{pad}{2 if pad else ''}}{sep}{r.randrange(2000, 2031)}"
        return {
            "w": self.word, "date": lambda: date, "h": lambda: str(r.randrange(1, 99)), "year": lambda: str(r.randrange(2000, 2030)), "P": lambda: self.family().capitalize(),
            "num": lambda: self.pick([self.digits(7), "3" + self.digits(9), "0" + self.digits(6), str(r.randrange(2000, 2030)) + "/" + self.digits(5), self.digits(5)]),
            "money": lambda: f"{r.randrange(1, 99)}.{r.randrange(100, 999)},{self.digits(2)}", "url": lambda: f"https://{self.syllables(2)}.example/{self.word()}/{self.digits(7)}",
            "I": lambda: self.pick(["A.B.", "M. B.", "X.Y.", "C. D."]), "I1": lambda: self.pick("ABCD"), "lot": lambda: self.pick(["AB", "Z", "PR-", "K"]) + self.digits(r.choice([2, 3])),
            "S": lambda: f"{self.pick(['Il', 'La', 'Un', 'Una'])} {self.word()} {self.word()} {self.word()} {self.pick(['il', 'la', 'un', 'dopo il', 'circa la'])} {self.word()}.",
        }[slot]()

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        out, gold, rest = "", [], self.pick(FRAMES)
        kinds = {"N": ("NOME", self.name), "T": ("TELEFONO", self.phone), "D": ("DOCUMENTO", self.document), "E": ("EMAIL", self.mail), "A": ("INDIRIZZO", self.street)}
        while "{" in rest:
            head, _, rest = rest.partition("{")
            slot, _, rest = rest.partition("}")
            out += head
            if slot in kinds:
                kind, make = kinds[slot]
                x = make()
                gold.append((len(out), len(out) + len(x), kind))
                out += x
            else:
                out += self.filler(slot)
        return out + rest, gold


    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """One to three sentences."""
        out, gold = "", []
        for _ in range(self.r.choice([1, 2, 2, 3])):
            x, spans = self.sentence()
            out += " " if out else ""
            gold += [(s + len(out), e + len(out), kind) for s, e, kind in spans]
            out += x
        return out, gold


def sentences(given: list[str], n: int = SENTENCES, seed: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n texts with the (start, end, kind) of what they hold."""
    maker = Maker(seed, given)
    return [maker.text() for _ in range(n)]
