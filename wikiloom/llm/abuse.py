"""Abusive, hateful and sexual content: expected severity by cumulative-link ordinal regression.

Texts are read whole, sentence by sentence. The sparse features of a sentence are hashed words and character n-grams of all its words,
and, where it has entries of the vocabulary (after folding look-alike letters, digits for letters, masked and stretched letters),
those entries, their classes and pairs of classes. All weights start at zero; every one of them comes from the labels.

For each kind the grade of a text is 0 (absent), 1 (reviewers disagree) or 2 (all say so): the labels name kinds, not degrees, so how many
reviewers say so is the only order they hold. One weight vector is shared by both thresholds: P(grade > j) = sigmoid(w.x - t_j), and the
score is the expected grade. A text's score is that of its worst sentence. A text with a label of a kind is represented by the
sentence that is worst for it, all other labelled texts by every sentence.

The regression is fitted once for each of FOLDS parts of the ids, without the labels of that part, and a labelled text is scored by the weights
of its own part only: no text is scored by weights that its own label has moved. Texts without a label are scored by the mean over the parts.

At most LABELLED texts are used for fitting, chosen by hash; everything else sees all rows.

Defined results: null, empty and wordless texts have score 0 and no kinds. Labels are read without case and spaces by
their first letters; null and unreadable labels play no part. Repeated rows count once. Without labels of both sides of a kind, all scores of it are 0.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("abusive", "hateful", "sexual")
LABELLED = 20_000
#: A kind is found from this expected grade on.
FOUND = 0.5

# The vocabulary by class, in the languages of the wikis (en, de, fr, es).
INSULT = """
idiot idiots moron morons imbecile imbeciles cretin cretins dumbass dumbasses asshole assholes arsehole bastard bastards bitch bitches bitchs scumbag
scumbags douchebag douchebags dipshit dipshits shithead shitheads wanker wankers twat twats prick pricks jackass jackasses retard retards retarded
dickhead dickheads cunt cunts whore slut fuckwit fucktard motherfucker loser losers tosser jerk halfwit dimwit
arschloch arschlocher vollidiot vollidioten idioten trottel schwachkopf schwachkopfe mistkerl mistkerle hurensohn hurensohne wichser depp deppen penner
spast fotze schlampe missgeburt drecksau dummkopf
connard connards connasse abruti abrutis debile debiles enfoire enfoires salaud salauds salope trouduc encule encules batard batards ordure ordures pute
imbecil imbeciles idiota idiotas cretino cretinos cabron cabrones gilipollas hijoputa hijoputas capullo capullos subnormal subnormales pendejo pendejos
estupido estupida puta zorra payaso payasos bruto brutos cretina
""".split()
SCORN = """
stupid pathetic worthless miserable garbage bullshit crap shitty shit lying fuck fucking damn useless disgrace
dumm dummes dummer dumme elender elende verlogener verlogene beschissen beschissene beschissenen scheisse scheiss mist
merde pauvre minable nul foutre menteur
mierda carajo mentiroso mentirosa inutil asco
""".split()
THREAT = """
smash choke drowned drown jump strangle beat punch kill shoot
schlag schlage zahne verprugle umbringen verrecke
casser crever creve tuer gueule tabasser
partir cara matar reventar romper
""".split()
BRUSH = """
shut verpiss fresse halt ferme degage vete callate banned
""".split()
YOU = """
you your yours yourself u ur youre
du dich dir dein deine deiner deinen euch ihr
tu te toi ta ton tes vous vos votre
tus ti vosotros eres tuya vuestra
""".split()
THAT = """
whoever admins nobody must mother edits page article
wer keiner anderungen artikel mutter
celui article mere
quien nadie pagina ediciones
""".split()
SLUR = """
vermin scum parasite parasites cockroach cockroaches rats rat pigs pig animals subhuman subhumans filth savages savage thieves thief insects dogs
ungeziefer untermensch untermenschen ratten schweine parasiten abschaum kakerlaken tiere pack gesindel diebe dreck
vermine cafard cafards parasites sous-hommes soushommes dechets voleurs betes racaille
alimana alimanas rata ratas escoria cucaracha cucarachas parasito parasitos cerdos cerdo ladrones animales plaga
""".split()
HARM = """
drowned exterminate exterminated sterilise sterilize hang hanged burn gas deport locked rid kick dead fire breed breeding subhuman disgusting dirty
ausgerottet ausrotten jagen vergasen toter tot vermehrt dreckige dreckiges vernichten
eliminer exterminer chasser mort crasseux crasseuse pendre bruler volent race
exterminar exterminarlos echar muerto inmunda inmundo reproducen colgar quemar merecen
""".split()
GROUP = """
all every they them their those people women kind hate trust last race
alle die sie dieses frauen leute
tous les ces leur leurs ils femmes gens
todos los esos ellos sus mujeres gente
""".split()
EXPLICIT = """
pussy pussies cock cocks dick dicks tits titties blowjob blowjobs porn porno pornos orgasm orgasms horny moaned cum handjob threesome xxx hardcore
nude nudes topless uncensored masturbate masturbated fucked
ficken fickt schwanz titten geil geile geilen stohnte orgasmus nacktbilder muschi wichsen blasen
bite baise baiser suca gemissait orgasme porno chatte nichons sodomie
polla pollas follar follando tetas gemia chupo orgasmo cachondo cachondos cachonda cono corrida
""".split()
BODY = """
naked thighs clothes bed thrust licked stripped stroked squeezed nude sex breast breasts nipples wet bare rode slid adults adult tonight pics
nackt bett schob erwachsene ausgezogen heute bilder
nu nue nus nues lit caressait cuisses seins adultes adulte photos chauds
desnudo desnuda desnudos cama muslos saco adultos adulto fotos agarro
""".split()
WORTH = "only nur solo vaut".split()
PERIOD = "period punkt punto final".split()
HARMLESS = """
kennels kennel whelped pups puppies crowed eye anatomy organs hatchlings nest hatch comet grain herds ticks apology honour honours songs blocked
insults insult explicit policy sword swords loaded trouble etymology
auge blossem komet korn getreide sperre beleidigungen vertrieben kehrten heim lied hund zuchter
oeil comete grain ble insulte blocage revinrent chasses poule coq
vista ojo cometa grano insulto bloqueo volvieron expulsados gallo
""".split()

CLASSES = {"insult": INSULT, "scorn": SCORN, "threat": THREAT, "brush": BRUSH, "you": YOU, "that": THAT, "slur": SLUR, "harm": HARM, "group": GROUP, "explicit": EXPLICIT, "body": BODY, "worth": WORTH, "period": PERIOD, "harmless": HARMLESS}
#: Classes of which one word makes a text worth reading by sentences.
TELLING = ("insult", "scorn", "threat", "slur", "harm", "explicit", "body")

# Look-alike letters and digits.
LOOKALIKE = str.maketrans("асеорхуіѕјһԁкмтвнԛԝɡαονρτυι", "aceopxyisjhdkmtbhqwgaovptui")
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
LEET = (str.maketrans("4@35$0178", "aaessoitb"), str.maketrans("4@35$0178", "aaessoltb"))

_WORD = re.compile(r"[\w*@$]+(?:[-'’][\w*@$]+)*")
_SENTENCE = re.compile(r"[\r\n  ]+|(?<=[.!?…])\s+")
_LINE = re.compile(r"[\r\n  ]+")
_LONG = re.compile(r"(.)\1{2,}")
_SPELT = re.compile(r"(?<![\w*])[\w*](?:[ .\-–_]{1,3}[\w*](?![\w*])){2,}")
_APART = re.compile(r"[ .\-–_]+")

_INDEX: dict[str, list[str]] = {}
for _c, _ws in CLASSES.items():
    for _w in _ws:
        _INDEX.setdefault(_w, []).append(_c)
_BY_SIZE: dict[int, list[str]] = {}
for _w in _INDEX:
    if len(_w) > 2 and any(c in ("insult", "scorn", "slur", "explicit", "body", "harm") for c in _INDEX[_w]):
        _BY_SIZE.setdefault(len(_w), []).append(_w)


_ALIKE = LOOKALIKE | INVISIBLE
_COMBINING = re.compile(f"[{''.join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c))}]+")


def _plain(text: str) -> str:
    """Without look-alikes, invisible characters and accents."""
    return _COMBINING.sub("", unicodedata.normalize("NFD", text.translate(_ALIKE))).replace("ß", "ss").replace("œ", "oe")


_plain_letter = lru_cache(maxsize=70_000)(_plain)


def _unspelt(t: str) -> str:
    """Lower case text without invisible characters, look-alikes and accents."""
    if not t.isascii():
        rare = {c: to for c in set(t) if c > "\x7f" and (to := _plain_letter(c)) != c}
        # What the replacements leave may be a letter that is replaced itself, and marks beyond the 16-bit range stay, ordered by the whole text.
        if all(map(str.isascii, rare.values())) and max(t) <= "\uffff":
            for c, to in rare.items():
                t = t.replace(c, to)
        else:
            t = _plain(t)
    return t


def fold(text: str) -> str:
    """Lower case, without invisible characters, look-alikes and accents, and with spelt-out words joined."""
    return _SPELT.sub(lambda m: _APART.sub("", m[0]), _unspelt(text.lower()))


@lru_cache(maxsize=300_000)
def entry(token: str) -> str | None:
    """The vocabulary entry that a folded token is, plainly or in disguise."""
    if token in _INDEX:
        return token
    forms = [token]
    if any(c in "4@35$0178" for c in token) and any(c.isalpha() for c in token) or sum(c in "4@35$0178" for c in token) == len(token) > 3:
        forms += [token.translate(m) for m in LEET]
    for f in list(forms):
        if _LONG.search(f):
            forms += [_LONG.sub(r"\1", f), _LONG.sub(r"\1\1", f)]
    for f in forms[1:]:
        if f in _INDEX and len(f) > 2:
            return f
    if "*" in token and any(c.isalpha() for c in token):
        for f in forms:
            p = re.compile(re.escape(f).replace(r"\*", "[^*]"))
            hits = [w for w in _BY_SIZE.get(len(f), ()) if p.fullmatch(w)]
            if hits:
                return hits[0]
    return None


_TELLING = {w for c in TELLING for w in CLASSES[c]}
#: Begins a feature that is no word.
MARK = "\0"


def marks(raw: str, words: list[str]) -> list[str]:
    """The vocabulary entries of a sentence, their classes and pairs of classes, if it has a telling word."""
    entries = list(dict.fromkeys(e for w in words if (e := entry(w)) is not None))
    if not any(e in _TELLING for e in entries):
        return []
    seen: dict[str, int] = {}
    for e in entries:
        for c in _INDEX[e]:
            seen[c] = seen.get(c, 0) + 1
    # Names begin with a capital letter inside the sentence.
    if re.search(r"(?<!^)(?<![.!?:] )\b[A-Z][a-z]{3,}", raw) or raw.isupper():
        seen["name"] = 1
    if len(words) <= 2:
        seen["alone"] = 1
    if " = " in raw:
        seen["equals"] = 1
    kinds = sorted(seen)
    pairs = [f"{a}+{b}" for i, a in enumerate(kinds) for b in kinds[i + 1 :]] + [f"{a}+{a}" for a in kinds if seen[a] > 1]
    return [MARK + x for x in [*(f"w:{e}" for e in entries), *kinds, *pairs]]


#: Folded words met so far, and those of them that are a telling entry, plainly or in disguise.
_MET: set[str] = set()
_TELL: set[str] = set()


def telling(words: set[str]) -> bool:
    """Whether any of the words tells; every word is looked at once, as long as the worker remembers it."""
    new = words - _MET
    if new:
        if len(_MET) > 300_000:
            _MET.clear()
            _TELL.clear()
            new = words
        _MET.update(new)
        _TELL.update(w for w in new if (e := entry(w)) is not None and e in _TELLING)
    return not _TELL.isdisjoint(words)


#: Two letters of their own beside each other, the least that _SPELT could join; a token between white spaces of separators only.
_TWO = re.compile(r"(?<![^\W_])(?<!\*)[\w*][.\-–_]{1,3}[\w*](?![^\W_]|\*)")
_ALONE = re.compile(r"(?<![^\W_])(?<!\*)[\w*](?![^\W_]|\*)|^[.\-–_]*$")


class Tokens(dict):
    """What stands between white spaces, lower case, met so far: its folded words, whether it ends a sentence, and "2" if letters in it may be spelt out, "1" if it may be
    a part of a spelt-out word with its neighbours, else "0"."""

    def __missing__(self, token: str) -> tuple[list[str], bool, str]:
        if len(self) > 300_000:
            self.clear()
        bare = token[:-1] if token[-1] in ".,!?" else token
        if bare.isascii() and bare.isalpha():
            self[token] = found = [bare], token[-1] in ".!?", "0" if len(bare) > 1 else "1"
            return found
        t = _unspelt(token)
        self[token] = found = _WORD.findall(t), t[-1:] in tuple(".!?…"), "2" if _TWO.search(t) else "1" if _ALONE.search(t) else "0"
        return found


_TOKENS = Tokens()


def sentences(text: str) -> list[list[str]]:
    """The folded words of every sentence that has words."""
    lines = [[_TOKENS[token] for token in line.split()] for line in _LINE.split(text.lower())]
    out = []
    for line in lines:
        words: list[str] = []
        for some, end, _ in line:
            words += some
            if end and words:
                out.append(words)
                words = []
        if words:
            out.append(words)
    signs = "0".join(["".join([sign for _, _, sign in line]) for line in lines])
    if "2" in signs or "111" in signs:  # else nothing is spelt out: three letters would stand in one token or in three
        return [w for x in _SENTENCE.split(fold(text)) if (w := _WORD.findall(x))]
    return out


def parts(text: str | None) -> list[list[str]]:
    """The distinct features of every sentence that has words: folded words, and marks()."""
    found = [list(dict.fromkeys(w)) for w in sentences(text or "")]
    if not telling(set().union(*found)):
        return found
    rows = [(raw, list(chain.from_iterable(sentences(raw)))) for raw in _SENTENCE.split(text)]
    return [[*dict.fromkeys(w), *(marks(raw, w) if telling(set(w)) else ())] for raw, w in rows if w]


HASH_BITS, GRAMS, FOLDS, SLICE = 18, (3, 4, 5), 4, 512
#: Of learn(): rounds of choosing sentences, steps of the ascent in each, its rate, the penalty on squared weights, the weight of a mark beside
#: a word's, and the share of texts without a kind that get its label all the same.
ROUNDS, STEPS, RATE, PENALTY, MARKED, WRONG = 3, 40, 0.15, 2.0, 4.0, 0.02
#: The thresholds at the start, below which they do not fall: few labels must not make a text without evidence count.
THRESHOLDS = (2.2, 3.2)

@lru_cache(maxsize=300_000)
def slots(word: str) -> tuple[int, ...]:
    """The slots of a word and of the character n-grams in it, or of a mark."""
    p = f"<{word}>"
    found = [word] if word[0] == MARK else [f"w {word}", *(p[i : i + n] for n in GRAMS for i in range(len(p) - n + 1))]
    return tuple({zlib.crc32(x.encode("utf-8", "replace")) >> (32 - HASH_BITS) for x in found})


def weight(word: str) -> float:
    return MARKED if word[0] == MARK else 1.0


class Words:
    """Sentences of texts as arrays: text of each sentence, sentence and word of each occurrence, and the slots of the words."""

    def __init__(self, texts: pa.Array):
        """texts: the sentences of each text, and their features, as list<list<string>>."""
        sentences, count = texts.flatten(), lambda x: np.asarray(x.value_lengths().fill_null(0), np.int64)
        coded = sentences.flatten().dictionary_encode()
        ids = coded.dictionary.to_pylist()
        self.texts = len(texts)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), count(texts))
        self.sentence = np.repeat(np.arange(len(self.text), dtype=np.int32), count(sentences))
        self.word = coded.indices.to_numpy().astype(np.int32)
        found = [slots(w) for w in ids]
        self.n = len(found)
        size = np.array([len(x) for x in found], np.int64)
        self.of = np.repeat(np.arange(self.n, dtype=np.int32), size)
        self.slot = np.fromiter((y for x in found for y in x), np.int32, int(size.sum()))
        self.value = (np.array([weight(w) for w in ids]) / np.sqrt(np.maximum(size, 1)))[self.of]
        self.starts = np.flatnonzero(np.r_[True, self.text[1:] != self.text[:-1]]) if len(self.text) else np.zeros(0, np.int64)
        # What every fit would else sort again: occurrences by word, slots of words by slot, and the distinct pairs of text and word.
        self.by_word, self.by_slot = (np.argsort(x, kind="stable").astype(np.int32) for x in (self.word, self.slot))
        once = np.unique(self.text[self.sentence].astype(np.int64) * max(self.n, 1) + self.word)
        self.once = (once // max(self.n, 1)).astype(np.int32), (once % max(self.n, 1)).astype(np.int32)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """w.x of each sentence."""
        each = np.bincount(self.of, weights=weights[self.slot] * self.value, minlength=self.n)
        return np.bincount(self.sentence, weights=each[self.word], minlength=len(self.text))

    def worst(self, values: np.ndarray) -> np.ndarray:
        """The largest value of the sentences of each text; 0 for none."""
        out = np.zeros(self.texts)
        if len(self.starts):
            out[self.text[self.starts]] = np.maximum.reduceat(values, self.starts)
        return out


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted keys and where each begins."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], first


def sums_of(x: Words, at: np.ndarray, slots_: np.ndarray):
    """What learn() sums up in every step over the sentences that have a row (at: row of each sentence, rising, or -1): w.x of each row, and what
    the slots (slots_) get of a value of each row. Occurrences and slots stand in the order of their sums, so a step only gathers and adds up runs."""
    n = int(at.max(initial=-1)) + 1
    row = at[x.sentence]
    kept = row >= 0
    row_of, first_row = runs_of(row[kept])
    word_at = x.word[kept].astype(np.int64)
    back_word, back_row = x.word[x.by_word], row[x.by_word]
    kept = back_row >= 0
    back_row = back_row[kept]
    words, first_word = runs_of(back_word[kept])
    number = np.full(x.n, -1)
    number[words] = np.arange(len(words))
    word_at = number[word_at]
    # Slots of the words that occur, by word, and by slot.
    of = number[x.of]
    kept = of >= 0
    slot_at = np.searchsorted(slots_, x.slot[kept])
    first_of = runs_of(of[kept])[1]  # every word has a slot
    each = x.value[kept][first_of]  # a word's slots have one value
    of = of[x.by_slot]
    kept = of >= 0
    back_of = of[kept]
    taken, first_slot = runs_of(x.slot[x.by_slot][kept])
    taken = np.searchsorted(slots_, taken)

    def added(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, first) if len(first) else np.zeros(0)

    def into(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[row_of] = added((added(v.take(slot_at), first_of) * each).take(word_at), first_row)
        return out

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(slots_))
        out[taken] = added((added(g.take(back_row), first_word) * each).take(back_of), first_slot)
        return out

    return into, back


def learn(x: Words, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, tuple[float, float]] | None:
    """Fit one kind's grades y on the texts in `use`: of a text with a grade its worst sentence, of all others every sentence."""
    positive, n_positive = (y > 0) & use, int(((y > 0) & use).sum())
    if not 0 < n_positive < int(use.sum()):
        return None
    # At first the log-odds of words by texts tell which sentence stands for its text.
    text, word = x.once
    base = (n_positive + 1) / (int(use.sum()) + 2)
    hits, seen = np.bincount(word, weights=positive[text], minlength=x.n), np.bincount(word, weights=use[text], minlength=x.n)
    odds = np.log((hits + 5 * base) / (seen - hits + 5 * (1 - base))) - np.log(base / (1 - base))
    z = np.bincount(x.sentence, weights=np.maximum(odds[x.word], 0), minlength=len(x.text))
    w, t = np.zeros(1 << HASH_BITS), np.array(THRESHOLDS)
    some = np.unique(x.slot)  # the weights of all other slots stay zero
    for _ in range(ROUNDS):
        rows = np.flatnonzero(np.where(positive[x.text], z >= x.worst(z)[x.text], use[x.text]))
        at = np.full(len(x.text), -1)
        at[rows] = np.arange(len(rows))
        target = y[x.text[rows]] * positive[x.text[rows]]
        above = [np.flatnonzero(target > j) for j in range(2)]
        into, back = sums_of(x, at, some)
        v, mean, square = w[some], np.zeros(len(some)), np.zeros(len(some))
        for step in range(1, STEPS + 1):
            score_ = into(v)
            g, gt = np.zeros(len(rows)), np.zeros(2)
            for j in range(2):
                p = 1 / (1 + np.exp(-(score_ - t[j])))
                d = -p
                own = p[above[j]]
                d[above[j]] = (1 - WRONG) * own * (1 - own) / (WRONG + (1 - WRONG) * own)
                g += d
                gt[j] = -d.sum()
            up = back(g) - PENALTY * v
            mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up * up
            v += RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1)
            # Not below the prior thresholds: few labels must not make a text without evidence count.
            t = np.maximum(t + 0.3 * gt / (1 + np.abs(gt)), THRESHOLDS)
            t[1] = max(t[1], t[0] + 0.2)
        w[some] = v
        z = x.sums(w)
    return w.astype(np.float32), (float(t[0]), float(t[1]))


def expected(z: np.ndarray, thresholds: tuple[float, float]) -> np.ndarray:
    """The expected grade."""
    return sum(1 / (1 + np.exp(-(z - t))) for t in thresholds)


class Scorer:
    """Scores by learn()'s weights; a word's sum is looked up once."""

    def __init__(self, learned: list, most: int = 300_000):
        """learned: what learn() gives for each part and kind, by part."""
        self.flat = learned
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.flat)))

    def add(self, words: list[str]) -> None:
        found = [np.array(slots(w)) for w in words]
        size = np.array([len(x) for x in found])
        slot, first = np.concatenate(found), np.cumsum(size) - size
        scale = np.array([weight(w) for w in words]) / np.sqrt(size)
        new = [np.zeros(len(words)) if m is None else np.add.reduceat(m[0][slot].astype(np.float64), first) * scale for m in self.flat]
        self.ids.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.sums = np.concatenate([self.sums, np.stack(new, axis=1)])

    def __call__(self, texts: list[list[list[str]]], part: list[int]) -> np.ndarray:
        """[text, kind]: the expected grade of the worst sentence, under the weights of the text's part, or the mean over the parts where part
        is negative; 0 without words."""
        out = np.zeros((len(texts), len(KINDS)))
        if len(self.ids) > self.most:
            self.clear()
        words = list(chain.from_iterable(chain.from_iterable(texts)))
        word = list(map(self.ids.get, words))
        if None in word:
            self.add([w for w in dict.fromkeys(words) if w not in self.ids])
            word = list(map(self.ids.get, words))
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        if not len(text):
            return out
        size = np.array(list(map(len, chain.from_iterable(texts))))
        z = np.add.reduceat(self.sums[np.array(word)], np.cumsum(size) - size)
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        of = text[first]
        worst = np.maximum.reduceat(z, first)
        grade = np.stack([np.zeros(len(of)) if m is None else expected(worst[:, i], m[1]) for i, m in enumerate(self.flat)], axis=1).reshape(len(of), -1, len(KINDS))
        own = np.array(part)[of]
        out[of] = np.where((own < 0)[:, None], grade.mean(axis=1), grade[np.arange(len(of)), np.maximum(own, 0)])
        return out


def _part(key: str):
    """The part of the ids that a row belongs to."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("part")), F.lit(FOLDS)).cast("int")


def grades(labels: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and the array of labels of at most LABELLED labelled texts, chosen by hash."""
    first = F.substring(F.regexp_replace(F.lower("label"), "[^a-z]", ""), 1, 1)
    label = F.when(first == "a", "abusive").when(first == "h", "hateful").when(first == "s", "sexual").when(first == "o", "ok")
    rows = labels.select(key, label.alias("label"), "reviewer").where("label is not null").distinct()
    per = rows.groupBy(key).agg(F.collect_list("label").alias("labels")).orderBy(F.xxhash64(key), key).limit(LABELLED)
    return F.broadcast(per).join(docs.select(key, text).where(F.col(text).isNotNull()), key).dropDuplicates([key])


def examples(labels: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> pa.Table:
    """id, part, found (features of all sentences) and labels of the labelled texts, made on the executors."""

    def run(batches):
        for b in batches:
            found = pa.array([parts(t) for t in b.column(1).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), found, b.column(2)], names=["id", "part", "found", "labels"])

    rows = grades(labels, docs, key, text).select(F.col(key).cast("long").alias("id"), text, "labels", _part(key).alias("part"))
    return rows.mapInArrow(run, "id long, part int, found array<array<string>>, labels array<string>").toArrow().sort_by("id").combine_chunks()


def grade(labels: list[str]) -> dict[str, int]:
    """The grade of every kind that a text's labels tell of."""
    return {k: 0 if k not in labels else 2 if labels.count(k) == len(labels) else 1 for k in KINDS}


def train(labels: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[list, list[int]]:
    """What is learnt for each part of the ids, without the part's own labels, and kind; and the ids of the labelled texts.

    The fits run side by side on the executors.
    """
    rows = examples(labels, docs, key, text)
    if not rows.num_rows:
        return [None] * (FOLDS * len(KINDS)), []
    found = [grade(r) for r in rows["labels"].to_pylist()]
    y = {k: np.array([g[k] for g in found]) for k in KINDS}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((Words(rows["found"].combine_chunks()), y, rows["part"].to_numpy()))

    def run(batches):
        x, y, part = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                m = learn(x, y[KINDS[i % len(KINDS)]], part != i // len(KINDS))
                if m is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pa.compress(m[0].tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([list(m[1])])], names=["i", "weights", "thresholds"])

    out: list = [None] * (FOLDS * len(KINDS))
    for r in spark.range(0, len(out), 1, len(out)).mapInArrow(run, "i long, weights binary, thresholds array<double>").collect():
        out[r.i] = np.frombuffer(pa.decompress(bytes(r.weights), 4 << HASH_BITS, "zstd", asbytes=True), np.float32), tuple(r.thresholds)
    shared.destroy()
    return out, rows["id"].to_pylist()


def scored(docs: DataFrame, model: tuple[list, list[int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but the text, with the expected severities abusive, hateful and sexual of every row."""
    keep = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned, labelled = shared.value
        scorer, labelled = Scorer(learned), set(labelled)
        for b in batches:
            values = []
            for some in batched(zip(*(b.column(i).to_pylist() for i in range(3))), SLICE):
                values += scorer([parts(t) for t, _, _ in some], [f if i in labelled else -1 for _, f, i in some]).tolist()
            cols = [pa.array([v[k] for v in values], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[3:], *cols], names=[*keep, *KINDS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"{k} double" for k in KINDS)])
    return docs.select(text, _part(key).alias("_part"), F.col(key).cast("long").alias("_id"), *keep).mapInArrow(run, schema)


def kinds(rows: DataFrame, found: float = FOUND) -> DataFrame:
    """One row per kind whose expected severity reaches `found`."""
    pairs = F.array(*(F.when(F.col(k) >= found, F.lit(k)) for k in KINDS))
    return rows.withColumn("kind", F.explode(F.array_compact(pairs)))
