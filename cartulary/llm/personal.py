"""Personal information in free text: a semi-Markov conditional random field.

A text is cut into segments, each of one kind or of none. Candidate segments come from
patterns that are meant to propose too much (any number that could be a telephone, any run of
capital words); what is a case is decided by the field. Every candidate is scored as a whole,
by features of the segment (kind, shape, classes of its words, number of digits) and of what
stands around it, each with a weight. The segmentation with the greatest sum is found exactly
by dynamic programming over the ends of segments of bounded length; what no segment covers
scores 0.

The weights are trained: the likelihood of the labelled segmentations of ``labelled.SENTENCES``
sentences made by rule (``labelled.py``) is raised by gradient steps, the expected features
coming from the forward and backward sums over all segmentations. That takes a few seconds on
the driver, once a process, and gives the same weights every time. The list of given names is
one feature among others; half of the names trained on are not in it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.labelled import sentences
from cartulary.llm.tokens import texts
from cartulary.session import spread

EMAIL, PHONE, DOCUMENT, STREET, NAME = "EMAIL", "TELEFONO", "DOCUMENTO", "INDIRIZZO", "NOME"

Span = tuple[int, int, str]

#: (start, end, kind, features)
Candidate = tuple[int, int, str, tuple[str, ...]]

#: Passes over the labelled sentences, first step, pull of the weights towards 0.
PASSES, STEP, PULL = 10, 0.5, 0.0005

_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|chiocciola)\s?[\])}]\s?|\s(?:at|chiocciola)\s)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punto)\s?[\])}]\s?|\s(?:dot|punto)\s)"
_EMAIL = re.compile(rf"(?i)(?<![\w.+'-])\w[\w.+'’%-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_HAS_AT = re.compile(r"(?i)@|chiocciola|\bat\b")

_PHONE = re.compile(r"(?<![\w/.+-])(?:(?:\+|00)39[\s./-]?)?(?:\(?0\d{1,3}\)?|3\d\d)(?:[\s./-]{0,2}\d){5,9}(?![\w/]|[.-]\d)")
_FOREIGN = re.compile(r"(?<![\w/.+-])(?:\+|00)(?!39)[1-9]\d{0,2}(?:[\s./-]{0,2}\d){6,12}(?![\w/]|[.-]\d)")
#: What numbers a file, a case, a page or an amount, standing right before the digits.
_NUMBERED = re.compile(r"(?i)(?:\bn[.°º]?|\bnum\.|\bnr\.?|\bprot\.|\bprotocollo|fascicolo|\bscheda/?|\bruolo|\bpratica|\blotto|\bturno|\beuro|/)\s*$")
_DATE = re.compile(r"\d{1,2}([./-])\d{1,2}\1\d{4}$")
_CALLED = re.compile(r"(?i)(?:\btel\.?|\bcell\.?|\bfax|telefono|cellulare|numero|contatto|chiama|chiamare il|utenza|oppure al|tutore:)\s*:?\s*$")

_TAX = re.compile(r"(?i)(?<![\w-])[a-z]{3}[\s-]?[a-z]{3}[\s-]?[\dlmnpqrstuv]{2}[a-z][\dlmnpqrstuv]{2}[\s-]?[a-z][\dlmnpqrstuv]{3}[\s-]?[a-z](?![\w-])")
_CODE = re.compile(r"(?i)(?<![\w-])(?:[a-z]{2}[\s-]?\d{7}|[a-z]{2}[\s-]?\d{6}|[a-z]{2}\d{5}[a-z]{2}|[a-z]\d{8}|\d{2}[a-z]{2}\d{3}[a-z])(?![\w-])")
_MIXED = re.compile(r"(?i)(?<![\w/@.-])(?=[a-z]{0,4}\d)(?=(?:[a-z]*\d){5})(?=\d*[a-z])[a-z\d]{7,10}(?![\w-])")
_HELD = re.compile(r"(?i)(?:passaporto|documento|tessera|permesso|carta|cui|c\.\s?f\.|fiscale|patente|identità)(?:\s+(?:n[.°º]?|num\.|nr\.?))?\s*:?\s*$")

_WAY = r"(?:via|viale|v\.le|v\.|piazza|p\.?zza|piazzale|p\.?le|piazzetta|corso|c\.so|largo|l\.go|vicolo|vico|vic\.|strada|str\.|contrada|c\.da|salita|lungomare|galleria|traversa|borgo)"
_LINK = r"(?:(?:d|del|dell|della|dello|dei|degli|delle|di|da|san|santa|e|la|le|i|il)\s+|(?:dell|d|l)['’]\s?)"
_NUMBER = r"(?:\d{1,4}(?:\s?/\s?[a-z](?!\w)|\s(?:bis|ter|quater)(?!\w)|(?-i:[A-Z])(?![\w'’])|\s(?-i:[A-Z])(?![\w.'’])|(?-i:[a-z])(?!\w))?(?!\w|[./]\d)|s\.\s?n\.\s?c\.|s\.\s?n\.(?!\s?c)|snc(?!\w))"
_STREET = re.compile(rf"(?i)(?<![\w.@'’-]){_WAY}\s?{_LINK}{{0,3}}(?-i:[A-ZÀ-Ý])[\w'’.-]*(?:\s{_LINK}{{0,2}}(?-i:[A-ZÀ-Ý])[\w'’-]*){{0,4}}\s?,?\s?(?:(?:n[.°º]{{0,2}}|num\.|nr\.?|civ\.|civico)\s?)?{_NUMBER}")
_LOWER_STREET = re.compile(rf"(?<![\w.@'’-]){_WAY}\s?{_LINK}{{0,3}}[^\W\d_]+(?:\s[^\W\d_]+)?\s?,?\s?(?:(?:n[.°º]{{0,2}}|civ\.)\s?)?{_NUMBER}")
_LIVES = re.compile(r"(?i)(?:\bin|recapito|incontri:|\bda|\ba|;|residente|studio[^.;]{0,60},)\s*$")

GIVEN = frozenset(
    """ada adele agata alba alberto alessandra alessandro alessia alessio alfredo alice alvaro amadou amina andrea angela angelo anna antonella antonio ahmed ali aster
    bakary barbara beatrice bianca blessing bruno camilla carla carlo carmela caterina cecilia chiara claudia claudio cristina daniela daniele dario davide
    desirée diego dilnoza dino domenico donatella edoardo elena eleonora elio elisa emanuele emma enrico enzo ernesto ettore eva fabio fabrizio fatima fatoumata federica
    federico filippo flavia fosca francesca francesco franco fulvio gabriele gaia gemma giacomo gianni giorgia giorgio giovanna giovanni giulia giuliano giulio giuseppe
    grazia greta halima hassan ibrahim idris ilaria ines irene isabella ivan ivo kofi kwame laura lea leonardo leyla lidia livia lorenzo luca lucia luciano luigi
    luisa maddalena manuela marcello marco margherita maria mariam mario marta martina massimo matilde matteo maurizio michele mohamed monica moussa nadia nasrin
    niccolò nicola nicoletta nino noor oleksiy olga omar orso ottavia paola paolo pasquale patrizia pavlo pietro piero rachele rafiq raffaele renata renato renzo riccardo rita
    roberta roberto rocco rosa salvatore samira samuele sandro sara selam sergio silvia silvio simona simone sofia stefania stefano susanna tariq teresa tesfaye
    tiziana tommaso tullio ugo umberto valentina valeria vera vincenzo viola vittoria vittorio walter yusuf zahra""".split()
)
PARTICLES = frozenset("de del della dello degli dei di da d el al ben bin ibn abu lo la van von der".split())
#: Words right before a name, never part of one.
TRIGGERS = frozenset(
    """avv avvocato dott ssa dottor dottore dottoressa ra sig signor signora ing prof estensore presidente relatore relatrice giudice difensore difensori
    referente firmato interprete straniero straniera ricorrente richiedente personalmente sentiti sentito sentita nome poi per posizione mediatore mediatrice turno""".split()
)
#: Words before a name in small letters and at the sides of one: no family names.
_STOP = TRIGGERS | frozenset(
    """di a da in con su tra fra e o il lo la i gli le un una uno l è che nei negli nelle nella nello sui sugli sulle sulla dai dalla dalle agli ai alle allo non si ha al del della dei nel ed da dal alla ad
    rinuncia insiste fissa conferma indica inviata inviato residente titolare documento causa giudizio prosegue procedimento notificato mani studio favore attenzione
    confronti nota vista viste visto ricorre cittadino sottoscritto domicilio eletto presso tessera permesso codice fiscale passaporto alloggiato alloggiata intestato affidata
    istruttoria liquidazione segnalazione responsabile recapito contatto comunicazioni chiede oppone trasmesso scrivere chiamare comparso assistito assistita dall dell figlio figlia minore
    nucleo plico sede numero utenza chiama vedi fascicolo lotto rif prot iscritto modulo contrassegno importo sul si come le rispondere reperibile abita trasferimento
    art par pag cap capi via viale piazza corso largo vicolo strada contrada scala cell tel posta pec cf""".split()
)
#: Words after which a name in small letters may begin.
_BEFORE_LOWER = TRIGGERS | frozenset("di a da e del della".split())
#: Prepositions that begin no name written in small letters.
_PREPOSITIONS = frozenset("di da del dei degli dello d la lo".split())

_WORD = re.compile(r"(?<![\w@.'’+-])(?:[^\W\d_][̀-ͯ]*)+(?:['’-](?:[^\W\d_][̀-ͯ]*)+)*(?![\w@])")
_ABBREVIATED = re.compile(r"(?:sig|dott|avv|prof|ing)\.\s?$|(?:\.\s?ra|dott\.?\s?ssa)\.?\s?$", re.I)

#: Words of a name by class: G given name, I initial, P particle, C capital word. Upper class
#: letters stand for words with a capital, small ones for words without. A run in small
#: letters needs a listed name or an initial.
_KINDS = re.compile(r"(?:P{0,2}[GCI](?:[GCI]|[Pp])*[GC]|g{1,3}p{0,2}c|p{0,2}cg{1,3}|ip{0,2}c)$")

#: A text without two capital words in a row, an initial and a listed name has no name.
_TWO = re.compile(r"(?:[A-ZÀ-Ý][\w'’-]*|[A-ZÀ-Ý]\.)\s{1,2}(?:[^\W\d_]{1,5}\s{1,2}){0,2}[A-ZÀ-Ý]|(?<![\w.])[^\W\d_]\.\s{1,2}[^\W\d_]{3}")
_PLAIN = re.compile(r"[^\W\d_]+")

_classes: dict[str, str] = {}


def word_class(word: str) -> str:
    """G, I, P, C of a word with a capital, g, p, c without; S for words no name holds."""
    known = _classes.get(word)
    if known is None:
        low = unicodedata.normalize("NFC", word).lower().replace("’", "'")
        if all(p in GIVEN for p in low.split("-")):
            known = "g"
        elif low in PARTICLES:
            known = "p"
        elif low in _STOP or len(low) < 2 or low.split("'")[0] in ("l", "un", "dall", "dell", "all", "nell", "sull", "quell"):
            known = "s"
        else:
            known = "c"
        known = known.upper() if word[0].isupper() and known != "s" else known
        if len(_classes) < 200_000:
            _classes[word] = known
    return known


_LAST = re.compile(r"([^\W\d_]+[.'’°º]?|\d+|[^\w\s])\s*$")


def _around(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    """The word or mark before, the one before that, the letters between, what follows."""
    before = text[max(0, start - 40) : start]
    m = _LAST.search(before)
    if not m:
        return "^", "^", "", text[end : end + 1]
    one = "#" if m[1].isdigit() else m[1].lower()
    n = _LAST.search(before[: m.start()])
    two = "^" if not n else "#" if n[1].isdigit() else n[1].lower()
    return one, two, before[m.end(1) :], text[end : end + 1]


def _features(text: str, start: int, end: int, kind: str, shape: list[str], classes: list[tuple[str, re.Pattern]]) -> tuple[str, ...]:
    one, two, gap, after = _around(text, start, end)
    before = text[max(0, start - 80) : start]
    kind_of = lambda x: "a" if x.islower() else "A" if x.isalpha() else "9" if x.isdigit() else x
    follows, further = kind_of(after), kind_of(text[end : end + 4].strip()[:1])
    told = [f"<{name}" for name, pattern in classes if pattern.search(before)]
    return tuple(f"{kind} {x}" for x in ["", *shape, *told, f"1={one}", f"2={two}", f"gap{len(gap)}", f">{follows}", f">>{follows}{further}"])


_PHONE_CLASSES = [("numerato", _NUMBERED), ("chiamato", _CALLED), ("tenuto", _HELD)]
_DOCUMENT_CLASSES = [("numerato", _NUMBERED), ("tenuto", _HELD)]
_STREET_CLASSES = [("abita", _LIVES)]


def _names(text: str) -> Iterator[Candidate]:
    """Runs of two to five words that only white space sets apart."""
    if not _TWO.search(text) and GIVEN.isdisjoint(_PLAIN.findall(text.lower())):
        return
    tagged: list[tuple[int, int, str, str]] = []
    for m in _WORD.finditer(text):
        s, e, w = m.start(), m.end(), m.group()
        if len(w) == 1 and text[e : e + 1] == "." and text[e + 1 : e + 2].isspace():
            tagged.append((s, e + 1, "I" if w.isupper() else "i", w))
        else:
            tagged.append((s, e, word_class(w), w))
    n = len(tagged)
    for i in range(n - 1):
        kind = tagged[i][2]
        if kind == "s" or (kind == "c" and tagged[i + 1][2] != "g") or (kind == "p" and not (i + 2 < n and tagged[i + 2][2] == "g")):
            continue
        if kind == "p" and tagged[i][3] in _PREPOSITIONS:
            continue
        kinds, last = kind, tagged[i - 1][3].lower() if i else ""
        led = bool(i) and text[tagged[i - 1][1] : tagged[i][0]].strip(" .\u00a0\u2009\u202f:,;") == "" and (last in TRIGGERS or last.rpartition("'")[2] in TRIGGERS)
        led = led or bool(_ABBREVIATED.search(text[max(0, tagged[i][0] - 9) : tagged[i][0]]))
        for j in range(i + 1, min(n, i + 5)):
            gap = text[tagged[j - 1][1] : tagged[j][0]]
            if not gap.isspace() or len(gap) > 2 or tagged[j][2] == "s":
                break
            kinds += tagged[j][2]
            if not _KINDS.match(kinds):
                continue
            start, end = tagged[i][0], tagged[j][1]
            small = kinds.islower()
            before = text[:start].rstrip()
            opens = not before or before[-1] in ".!?"
            more = j + 1 < n and text[end : tagged[j + 1][0]].isspace() and tagged[j + 1][2] in "GCgc" and (tagged[j + 1][2].isupper() or small)
            shape = [kinds, f"{len(kinds)} parole", "piccole" if small else "grandi", "guidato" if led else "non guidato", f"{'g' in kinds.lower()} {led}", f"segue {more} {kinds[-1]}", f"apre {opens} {kinds[0]}", f"{small} {led} {opens} {last in _BEFORE_LOWER}"]
            capitals = sum(t[3].isupper() and len(t[3]) > 1 for t in tagged[i : j + 1])
            shape.append(f"maiuscole {min(capitals, 2)}")
            yield start, end, NAME, _features(text, start, end, NAME, shape, [])


def candidates(text: str) -> list[Candidate]:
    """Every candidate segment with its features."""
    found: list[Candidate] = []
    if _HAS_AT.search(text):
        for m in _EMAIL.finditer(text):
            sign = "@" if "@" in m[0] else "scritta" if re.search(r"[\[({]", m[0]) else "a parole"
            found.append((*m.span(), EMAIL, _features(text, *m.span(), EMAIL, [sign, "spazi" if " " in m[0] else "intera"], [])))
    if any(c in text for c in "0123456789"):
        for pattern, origin in ((_PHONE, "interno"), (_FOREIGN, "estero")):
            for m in pattern.finditer(text):
                s, e = m.span()
                if text[s] == "(":
                    s += 1
                digits = sum(c.isdigit() for c in m[0])
                lead = "+" if m[0].startswith(("+", "00")) else m[0].lstrip("(")[0]
                shape = [origin, f"cifre {digits}", f"inizia {lead}", f"{lead} {digits}", "data" if _DATE.match(m[0]) else "non data", "separato" if re.search(r"[ ./-]", m[0]) else "unito"]
                found.append((s, e, PHONE, _features(text, s, e, PHONE, shape, _PHONE_CLASSES)))
        for pattern, origin in ((_TAX, "fiscale"), (_CODE, "codice"), (_MIXED, "misto")):
            for m in pattern.finditer(text):
                form = re.sub(r"[^\W\d_]+", "L", re.sub(r"\d+", "9", m[0]))
                shape = [origin, form, "maiuscolo" if m[0].upper() == m[0] else "minuscolo", "spazi" if " " in m[0] else "unito"]
                found.append((*m.span(), DOCUMENT, _features(text, *m.span(), DOCUMENT, shape, _DOCUMENT_CLASSES)))
    for pattern, origin in ((_STREET, "nome grande"), (_LOWER_STREET, "nome piccolo")):
        for m in pattern.finditer(text):
            way = m[0].split()[0].lower()
            shape = [origin, f"via {way}", "senza numero" if m[0][-1] in ".cC" else "numero", f"{len(m[0].split())} parole"]
            found.append((*m.span(), STREET, _features(text, *m.span(), STREET, shape, _STREET_CLASSES)))
    found += _names(text)
    return found


def _sorted(found: list[Candidate]) -> list[Candidate]:
    """By end, one for each place and kind."""
    once = {(c[1], c[0], c[2]): c for c in found}
    return [once[k] for k in sorted(once)]


def _gradient(found: list[Candidate], gold: set[Span], weights: dict[str, float]) -> dict[str, float]:
    """Of the log-likelihood of the labelled segmentation: features of what is labelled, less
    those that are expected over all segmentations."""
    scores = [sum(weights.get(x, 0.0) for x in c[3]) for c in found]
    ends = [c[1] for c in found]
    before = [bisect_right(ends, c[0], 0, k) for k, c in enumerate(found)]  # segments that end by this one's start
    forward = [0.0]  # log of the sum over segmentations of the first k candidates
    for k, score in enumerate(scores):
        x, y = forward[k], forward[before[k]] + score
        forward.append(max(x, y) + math.log1p(math.exp(-abs(x - y))))
    out: dict[str, float] = {}
    weight = [0.0] * (len(found) + 1)  # probability that the walk back passes through k
    weight[-1] = 1.0
    for k in range(len(found) - 1, -1, -1):
        taken = math.exp(forward[before[k]] + scores[k] - forward[k + 1]) * weight[k + 1]
        weight[before[k]] += taken
        weight[k] += weight[k + 1] - taken
        pull = ((found[k][0], found[k][1], found[k][2]) in gold) - taken
        if abs(pull) > 1e-4:
            for x in found[k][3]:
                out[x] = out.get(x, 0.0) + pull
    return out


def trained(sample: list[tuple[str, list[Span]]], passes: int = PASSES) -> dict[str, float]:
    """Weights of the features from labelled texts, by gradient steps of falling size."""
    rows = []
    for text, gold in sample:
        found = _sorted(candidates(text))
        if found:
            rows.append((found, set(gold)))
    weights: dict[str, float] = {}
    sums: dict[str, float] = {}
    for _ in range(passes):
        for found, gold in rows:
            for x, g in _gradient(found, gold, weights).items():
                w = weights.get(x, 0.0)
                g -= PULL * w
                sums[x] = sums.get(x, 1e-6) + g * g
                weights[x] = w + STEP * g / math.sqrt(sums[x])
    return {x: round(w, 6) for x, w in weights.items() if w}


_models: list[dict[str, float]] = []


def model() -> dict[str, float]:
    """The weights, trained once a process."""
    if not _models:
        _models.append(trained(sentences(sorted(GIVEN))))
    return _models[0]


def segments(text: str | None, weights: dict[str, float] | None = None) -> list[Span]:
    """(start, end, kind) of the best segmentation, in order; none for null and empty."""
    if not text:
        return []
    found = candidates(text)
    if not found:
        return []
    weights = model() if weights is None else weights
    scored = sorted((c[1], c[0], c[2], score) for c in found if (score := sum(weights.get(x, 0.0) for x in c[3])) > 0)
    ends = [c[0] for c in scored]
    best, back = [0.0], [0]
    for k, (_, start, _, score) in enumerate(scored):
        at = bisect_right(ends, start, 0, k)
        with_it = best[at] + score
        best.append(max(best[k], with_it))
        back.append(at if with_it > best[k] else -1)
    out: list[Span] = []
    k = len(scored)
    while k:
        if back[k] < 0:
            k -= 1
        else:
            end, start, kind, _ = scored[k - 1]
            out.append((start, end, kind))
            k = back[k]
    return out[::-1]


def masked(text: str | None, weights: dict[str, float] | None = None) -> str | None:
    """The text with ``[KIND]`` in the place of every segment; all else as it is."""
    if not text:
        return text
    parts, at = [], 0
    for s, e, kind in segments(text, weights):
        parts += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*parts, text[at:]])


def found_spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, inizio, fine, tipo: every occurrence, in code points; null, empty and blank texts
    hold none, an empty table gives no row."""

    weights = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, s, e, kinds = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                for a, b, kind in segments(t, weights):
                    keys.append(k)
                    s.append(a)
                    e.append(b)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(kinds, pa.string())], names=[key, "inizio", "fine", "tipo"])

    kind = rows.schema[key].dataType.simpleString()
    return spread(rows.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())).mapInArrow(run, f"{key} {kind}, inizio int, fine int, tipo string")


def masked_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, testo of every row: ``masked`` of the text, null where it is null."""

    weights = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([masked(t, weights) for t in texts(batch.column(1))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[key, "testo"])

    kind = rows.schema[key].dataType.simpleString()
    return spread(rows.select(F.col(key), F.col(text))).mapInArrow(run, f"{key} {kind}, testo string")
