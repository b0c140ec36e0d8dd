"""Operator 4: URL verdicts by rules and, where no rule fits, by logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BINS, LOW, HIGH = 1 << 15, 3, 6
#: Gradient steps, step length and ridge of the training; the table is small, so the driver does it.
STEPS, RATE, RIDGE = 500, 2.0, 1e-5
#: Most rules and labelled URLs that travel with a task.
MOST_RULES, MOST_LABELLED = 100_000, 100_000


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null and where there is no ://."""
    rest = (url or "").partition("://")[2]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


@dataclass
class Rules:
    """(host, path, verdict) rules. One fits its host and all subdomains if the path starts with its own; the longest
    wins, host and path together, and among equally long ones the host's longer one."""

    rules: list[tuple[str, str, str]]

    def __post_init__(self):
        if len(self.rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in self.rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, tail = None, host
        while tail:
            for start, verdict in self.by_host.get(tail, ()):
                if path.startswith(start) and (best is None or len(tail) + len(start) > best[0]):
                    best = (len(tail) + len(start), tail + start, verdict)
            tail = tail.partition(".")[2]
        return best and best[1:]


def own_name(host: str) -> str:
    """A host without what any kind of site may have: its last label, and a leading www."""
    return host.removeprefix("www.").rpartition(".")[0]


def bins(host: str, path: str) -> np.ndarray:
    """The hashed n-grams of a URL, host and path apart, each once; a path's numbers are alike."""
    grams = set()
    for mark, text in (("h", f"^{own_name(host)}$"), ("p", re.sub("[0-9]+", "0", f"^{path.lower()}$"))):
        raw = text.encode()
        grams.update(mark.encode() + raw[k : k + n] for n in range(LOW, HIGH + 1) for k in range(len(raw) - n + 1))
    return np.unique(np.fromiter((zlib.crc32(g) % BINS for g in grams), np.int64, len(grams)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability that the URL is to be blocked."""
        k = bins(host, path)
        return float(1 / (1 + np.exp(-(self.bias + self.weights[k].sum() / np.sqrt(max(len(k), 1))))))


def train(labelled: list[tuple[str, int]]) -> Model:
    """Logistic regression on (url, 1 to block or 0), full-batch gradient steps; without rows every score is 0.5."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    rows = [bins(*split_url(url)) for url, _ in labelled]
    size = np.array([len(r) for r in rows], np.int64)
    own, column = np.repeat(np.arange(len(rows)), size), np.concatenate([np.zeros(0, np.int64), *rows])
    value = 1 / np.sqrt(np.maximum(size, 1))[own]
    y = np.array([label for _, label in labelled], float)
    w, b, before = np.zeros(BINS), 0.0, (np.zeros(BINS), 0.0)
    # Rows have length one, so the mean loss bends by less than a quarter and a half; steps with Nesterov's momentum.
    for k in range(STEPS if len(y) else 0):
        ahead = k / (k + 3)
        v, c = w + ahead * (w - before[0]), b + ahead * (b - before[1])
        error = 1 / (1 + np.exp(-(np.bincount(own, v[column] * value, len(y)) + c))) - y
        before = w, b
        w = v - RATE * (np.bincount(column, error[own] * value, BINS) / len(y) + RIDGE * v)
        b = c - RATE * error.mean()
    return Model(w, b)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: list[tuple[str, int]], threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of (page_id, url).

    The longest fitting rule decides; where none fits, rule is null and the model's score does: block from `threshold`
    on. score, the probability of block, is null where a rule decides. A null url or one without :// has empty host and
    path, which no rule fits. Repeated rows and null ids are rows like others. Urls of any length are read whole, in time
    that grows with their length. An empty table gives none; further columns are left, whatever their names.
    """
    known, model = Rules(rules), train(labelled)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                rule, verdict = known.match(host, path) or (None, None)
                score = None if rule else round(model.score(host, path), 9)
                out.append((page_id, host, path, rule, verdict or ("block" if score >= threshold else "allow"), score))
            types = [pa.int64(), *[pa.string()] * 4, pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url").mapInArrow(judged, "page_id bigint, host string, path string, rule string, verdict string, score double")


#: A small labelled URL table, drawn up by hand from what URLs of such sites commonly look like.
BLOCK = """
https://ads.doubleclick.net/click/17 https://ad.adserver.com/banner/728x90 https://adclick.g.example/aclk https://track.affiliate-network.com/click http://tracking.email-offers.biz/open.gif
https://ads.media-network.org/serve https://ads.publisher-group.net/banner https://adserver.news-portal.org/ads https://pixel.analytics-tracker.io/p.gif https://cdn.popads.net/pop.js https://popunder.example.biz/go https://clicks.ad-exchange.com/redirect https://banners.ad-partner.net/img
https://www.online-casino-bonus.com/free-spins https://casino.bet-winner.net/slots https://www.free-poker-chips.net/download https://slots-jackpot.com/play https://roulette.best-casino.org/bonus
https://www.sports-betting-tips.com/odds https://betting.bookmaker-odds.net/live https://www.lottery-winner.biz/claim https://bingo.play-win.com/register
https://www.cheap-viagra-online.com/buy https://buy-cialis.pharmacy-discount.net/order https://www.canadian-pharmacy-meds.com/pills https://cheap-pills.biz/no-prescription https://weight-loss-pills.net/offer
https://www.payday-loans-fast.com/apply https://cheap-loans.credit-now.biz/approved https://www.make-money-online-fast.com/signup https://get-rich-quick.biz/join https://bitcoin-doubler.net/invest
https://www.xxx-videos.com/watch https://porn.adult-tube.net/video https://www.sex-cams-live.com/models https://adult-dating.hot-singles.net/join https://nude-pics.xxx/gallery https://escort-girls.net/city
https://www.replica-watches-outlet.com/rolex https://cheap-handbags-outlet.net/sale https://www.essay-writing-service.com/order https://buy-followers.net/instagram https://cheap-seo-backlinks.com/buy
https://www.free-movie-download.net/torrent https://warez-crack-keygen.com/download https://serial-keys.crackz.net/full https://free-mp3-download.biz/track https://torrent-proxy.net/top
https://banner.ad-rotator.org/click https://ads.clicktracker.org/c https://www.casino-games.org/play https://free-pills-shop.org/order https://adult-chat-rooms.org/enter https://quick-loans.org/apply
https://secure-login.account-verify.biz/update https://paypal.com.verify-account.net/signin https://free-gift-card.win/claim https://iphone-winner.click/prize https://survey-rewards.top/win
""".split()
ALLOW = """
https://en.wikipedia.org/wiki/History_of_science https://de.wikipedia.org/wiki/Geschichte https://fr.wikipedia.org/wiki/Histoire https://es.wikipedia.org/wiki/Historia https://www.britannica.com/topic/philosophy
https://www.gutenberg.org/files/1342 https://archive.org/details/books https://www.bbc.co.uk/news/world https://www.theguardian.com/science/2021 https://www.nytimes.com/2020/05/12/health
https://www.reuters.com/article/markets https://www.lemonde.fr/international/article https://www.spiegel.de/politik/deutschland https://elpais.com/cultura/2019 https://www.nature.com/articles/s41586
https://arxiv.org/abs/1706 https://www.ncbi.nlm.nih.gov/pmc/articles https://www.who.int/health-topics https://www.nasa.gov/missions https://www.un.org/en/about-us https://europa.eu/law/treaties
https://www.gov.uk/guidance/tax https://www.loc.gov/collections https://www.mit.edu/research https://www.stanford.edu/news https://www.cam.ac.uk/students https://ocw.mit.edu/courses/physics
https://docs.python.org/3/library https://developer.mozilla.org/en-US/docs/Web https://stackoverflow.com/questions/11227809 https://spark.apache.org/docs/latest https://www.postgresql.org/docs/current
https://www.w3.org/TR/html5 https://tools.ietf.org/html/rfc2616 https://blog.rust-lang.org/2021 https://news.ycombinator.com/item https://www.kernel.org/doc/html https://wiki.archlinux.org/title/Installation
https://www.allrecipes.com/recipe/10813 https://www.seriouseats.com/bread https://www.lonelyplanet.com/france/paris https://www.nationalgeographic.com/animals https://www.smithsonianmag.com/history
https://www.imdb.com/title/tt0111161 https://www.goodreads.com/book/show https://blog.example-gardening.org/2020/spring https://forum.woodworking-club.org/thread https://www.chess-club.net/lessons
https://www.washingtonpost.com/opinions https://www.scientificamerican.com/article https://www.howstuffworks.com/engines https://www.poetryarchive.net/poets https://m.bird-watchers.net/sightings https://news.local-gazette.com/sport
https://m.weather-service.org/forecast https://library.city-archive.net/catalog https://museum.natural-history.org/exhibits https://www.community-choir.net/concerts https://school.village-teachers.org/timetable
""".split()
#: Words that tell what a site is for, and parts that any URL may have.
TELLING = """ads adserver banner clicktrack popunder affiliate casino poker roulette slots jackpot betting bookmaker lottery bingo viagra cialis pills pharmacy diet-pills payday loans quick-cash get-rich doubler
    porn xxx sex adult adult-x escort nude cams hot-singles replica fake-rolex essay-writing followers backlinks warez keygen crack torrent free-movies phishing verify-account free-gift winner prize spam spam-farm malware clickbait""".split()
PLAIN = """history science library museum archive school university college news journal gazette weather garden recipes kitchen travel hiking birds chess poetry music choir theatre books review forum community village
    city council health clinic research physics biology maths software docs developer linux python maps rail sport football cycling cinema gallery design photo crafts farm bakery blog wiki""".split()
PREFIXES = ("", "www.", "m.", "blog.", "news.", "shop.")
ENDINGS = ("com", "net", "org", "io", "biz", "info", "de", "co.uk")
PATHS = ("/", "/en/{0}", "/de/{0}/", "/fr/{0}.html", "/es/{0}", "/page/{0}", "/index.html", "/item/{0}")
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")
#: Made-up names in the table, besides those that stand next to a telling or plain word.
MADE_UP = 1500


def made_up(k: int) -> str:
    """A name that tells nothing, of two to four syllables, or of two to four pairs of a consonant and a vowel."""
    part = lambda i, step: SYLLABLES[(k * step + i) % len(SYLLABLES)] if k % 2 else "bcdfghklmnprstvwz"[(k * step + i) % 17] + "aeiou"[(k // 17 + i * step) % 5]
    return "".join(part(i * 5 + k // 31, step) for i, step in enumerate((7, 11, 13, 17)[: 2 + k % 3]))


def balanced() -> list[tuple[str, int]]:
    """Labelled URLs by a rule: names with a telling word are to be blocked; with a plain word, or made up, they are not.
    Every form of a name, prefix, ending and path has the same share of both, so that none of them tells anything."""
    forms = ("{0}", "{0}.example", "{1}-{0}", "{0}-{1}", "{1}-{0}.example", "{0}-{1}.example", "{0}.{1}", "{1}.{0}.example")
    names = [(form.format(w, made_up(8 * k + i)), label) for label, words in ((1, TELLING), (0, PLAIN)) for k, w in enumerate(words) for i, form in enumerate(forms)]
    names += [(forms[k % len(forms)].format(made_up(k), made_up(k + 701)), 0) for k in range(MADE_UP)]
    out, seen = [], {0: 0, 1: 0}
    for name, label in names:
        for _ in range(2):
            k = seen[label]
            seen[label] += 1
            out.append((f"https://{PREFIXES[k % len(PREFIXES)]}{name}.{ENDINGS[k // len(PREFIXES) % len(ENDINGS)]}{PATHS[k // 5 % len(PATHS)].format(k)}", label))
    return out


LABELLED = [(url, label) for label, urls in ((1, BLOCK), (0, ALLOW)) for url in urls] + balanced()
