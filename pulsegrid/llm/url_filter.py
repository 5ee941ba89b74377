"""URL filters: rules for hosts and paths, else logistic regression on hashed character n-grams.

Host and path are cut into character n-grams (3 to 5, with marks at the ends of a host's labels), hashed to a fixed number of
buckets. The regression is trained from a small table of labelled URLs whose size is bounded. Rules are looked up by the host and
each domain above it; the longest rule that fits wins, so a URL costs as many look-ups as its host has labels.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits and the model judges like any other;
repeated rows are judged alike; no pages, no rows; a very long url is judged whole, in some tens of times its size; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame

from pulsegrid.llm.common import map_texts

BUCKETS = 1 << 15
#: Labelled URLs and rules at most; both travel with each task.
MOST_LABELLED = 50_000
MOST_RULES = 50_000
AFTER = re.compile(rb"([^/?#]*)([^?#]*)", re.S)

#: Unwanted (1) and wanted (0) examples: words of hosts, each met with several forms of host and path. Plain words of either kind.
UNWANTED = """adult porn porno xxx sex sexy nude naked erotic escort hentai webcam-girls hookup swinger fetish
casino poker roulette blackjack jackpot slots bingo betting bets bookie sportsbook lottery gamble gambling wager
viagra cialis pills pharmacy steroids opioids weightloss diet-pills
spam spammer link-farm backlinks traffic-exchange popup popunder clickbait clicks adserver ads adclick tracker tracking
malware virus phishing keylogger trojan ransomware warez crack cracked keygen serials torrent pirated
payday-loan fast-cash get-rich forex-signals pump-dump replica-watches counterfeit""".split()
WANTED = """news daily times gazette herald weekly wiki library museum gallery theatre school college university academy science
physics chemistry biology history geography books review journal archive press blog forum community club shop store market
garden kitchen recipe bakery travel hotel airport weather sports football cricket tennis music film radio photo
health clinic hospital dentist law court city council parliament bank insurance energy water railway
software docs help support mail maps jobs charity church nature ocean river mountain forest island
carpenter plumber builder tailor farmer teacher writer painter planet satellite telescope engine bicycle harbour
reading writing cooking building parking cycling knitting fishing housing planning therapy theory families letters stories""".split()
#: Made-up names that count as wanted, so that a host of unknown letters isn't judged by a few n-grams alone.
MADE_UP = 1000


def made_up_names(n: int = MADE_UP, seed: int = 5) -> list[str]:
    """Names of three to twelve letters, consonants and vowels in turn more often than not."""
    draw, names = random.Random(seed), []
    while len(names) < n:
        name, vowel = "", draw.random() < 0.4
        for _ in range(draw.randint(3, 12)):
            name += draw.choice("aeiou" if vowel else "bcdfghjklmnpqrstvwxyz")
            vowel = vowel != (draw.random() < 0.7)
        names.append(name)
    return names


def labelled_urls() -> list[tuple[str, int]]:
    """The built-in table: (url, 1 if unwanted)."""
    forms = ["https://{}.example.com/en/{}", "http://www.{}.example.net/de/{}.html", "https://m.{}.example.org/fr/{}/", "http://blog.{}.example.net/es/{}?page=2"]
    forms += ["https://the-{}.example.com/", "http://{}online.example.org/a/{}", "http://my{}now.example.net/x/{}", "https://www.best-{}-{}.example.com/"]
    kinds = ((1, UNWANTED, forms), (0, WANTED, forms), (0, made_up_names(), forms[:4]))
    return [(form.format(word, 1000 + 37 * i), label) for label, words, shapes in kinds for i, word in enumerate(words) for form in shapes]


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """Host with A-Z lower-cased, and path."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    host, path = AFTER.match(rest).groups()
    return host.lower(), path


def grams(host: bytes, path: bytes) -> np.ndarray:
    """Buckets of the distinct n-grams. Digits are one sign, so that numbers in paths say nothing."""
    found: set[int] = set()
    for mark, text in ((1, b"." + host + b"."), (2, re.sub(rb"[0-9]+", b"0", path))):
        for n in (3, 4, 5):
            found.update(zlib.crc32(text[i : i + n], mark) for i in range(len(text) - n + 1))
    return np.fromiter((x % BUCKETS for x in found), np.int64, len(found))


class Regression:
    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights = bias, weights

    def score(self, host: bytes, path: bytes) -> float:
        at = grams(host, path)
        return float(1 / (1 + np.exp(-(self.bias + self.weights[at].sum() / np.sqrt(max(1, len(at)))))))

    @classmethod
    def fit(cls, labelled: Iterable[tuple[str, int]], rounds: int = 600, rate: float = 2.0, shrink: float = 1e-4) -> Regression:
        rows = sorted(labelled)
        if len(rows) > MOST_LABELLED:
            raise ValueError(f"{len(rows)} labelled URLs; at most {MOST_LABELLED}")
        each = [grams(*split_url(u.encode())) for u, _ in rows]
        y = np.array([k for _, k in rows], float)
        if not 0 < y.sum() < len(y):
            return cls(30.0 if len(y) and y.all() else -30.0, np.zeros(BUCKETS))
        at, row = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
        even = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both kinds weigh alike, whatever their numbers
        x = 1 / np.sqrt(np.maximum(1, np.array([len(e) for e in each])))[row]
        bias, w = 0.0, np.zeros(BUCKETS)
        for _ in range(rounds):
            error = even * (1 / (1 + np.exp(-(bias + np.bincount(row, weights=w[at] * x, minlength=len(y))))) - y)
            bias -= error.sum()
            w -= rate * (np.bincount(at, weights=error[row] * x, minlength=BUCKETS) * 10 + shrink * w)
        return cls(float(bias), w)


class Rules:
    """Rules (verdict, host, path) by host."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[bytes, list[tuple[bytes, str, str]]] = {}
        rules = list(rules)
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
        for verdict, host, path in rules:
            self.by_host.setdefault(host.lower().encode(), []).append((path.encode(), host + path, verdict))

    def find(self, host: bytes, path: bytes) -> tuple[str, str] | None:
        """The longest rule that fits; of equally long ones, that of the longer host, then block."""
        best = None
        while host:
            for start, name, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or (len(name), verdict == "block" and len(host) >= best[3]) > best[:2]):
                    best = (len(name), verdict == "block", (name, verdict), len(host))
            host = host.partition(b".")[2]
        return best[2] if best else None


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], keep: list[str], labelled: list[tuple[str, int]] | None = None, url: str = "url") -> DataFrame:
    """The ``keep`` columns of every row with host, path, rule, verdict (allow or block) and score (of being unwanted)."""
    table, model = Rules(rules), Regression.fit(labelled_urls() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast((table, model))

    def make() -> Callable[[list[bytes]], list]:
        table, model = shared.value

        def run(urls: list[bytes]) -> list:
            out = []
            for u in urls:
                host, path = split_url(u)
                rule, score = table.find(host, path), model.score(host, path)
                name, verdict = rule or (None, "block" if score >= 0.5 else "allow")
                out.append((host.decode(errors="replace"), path.decode(errors="replace"), name, verdict, score))
            return list(zip(*out, strict=True))

        return run

    return map_texts(pages, make, "host string, path string, rule string, verdict string, score double", keep, url)
