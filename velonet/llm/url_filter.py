"""Operator 9, URL filters: list rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, by theme. One strict term rejects an address. In place of a hyphen there may be _.
STRICT = (
    "adult-video", "bdsm", "camgirls", "escort", "escorts", "hardcore-sex", "hentai", "milf", "milfs", "nsfw", "nude-girls", "onlyfans-leak", "porn", "porno", "pornstar", "sex-cam", "sex-video", "xxx",
    "baccarat", "bet365", "blackjack", "casino", "casinos", "free-bets", "free-spins", "online-slots", "roulette", "slot-machine", "sportsbook",
    "buy-cialis", "buy-tramadol", "buy-xanax", "cheap-pills", "cheap-viagra", "cialis", "levitra", "no-prescription", "phentermine", "viagra", "weight-loss-pills",
    "crackz", "keygen", "keygens", "nulled", "serialz", "warez",
    "fake-id", "fake-passport", "payday-loan", "phishing", "replica-watches", "spam-farm", "work-from-home-jobs",
)
#: Hundredths that a soft term adds, once for each different term. REJECT hundredths reject an address.
SOFT = {
    50: ("ads", "adult", "affiliate", "bet", "bets", "betting", "bonus", "cheap", "click", "deal", "erotic", "farm", "free", "gamble", "gambling", "hookup", "jackpot", "loan", "loans", "lottery", "naked", "nude",
         "pill", "pills", "poker", "prize", "promo", "sex", "sexy", "slots", "spam", "torrent", "torrents", "track", "tracker", "win", "winner"),
    34: ("advert", "banner", "bargain", "bitcoin", "cash", "clearance", "clickbait", "coupon", "coupons", "crack", "credit", "crypto", "dating", "debt", "diet", "discount", "download", "earn", "forex", "gift", "giveaway",
         "guaranteed", "hack", "hot", "investment", "lucky", "miracle", "mortgage", "offer", "offers", "outlet", "pharma", "pharmacy", "popup", "profit", "referral", "refinance", "replica", "rich", "sale", "singles",
         "sponsor", "supplement", "sweepstakes", "unlimited", "voucher", "wholesale"),
}
REJECT = 100
#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; other letters as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the host or a parent of it and whose path begins the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer rules stand outside and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def spellings(term: str) -> list[str]:
    """A term, and with _ in place of its hyphens."""
    return list(dict.fromkeys((term, term.replace("-", "_"))))


def weights(strict: tuple[str, ...] = STRICT, soft: dict[int, tuple[str, ...]] = SOFT) -> dict[str, tuple[str, int]]:
    """Spelling -> (term, hundredths) of the whole vocabulary."""
    return {x: (t, w) for w, terms in {REJECT: strict, **soft}.items() for t in terms for x in spellings(t)}


def term_counts(strict: tuple[str, ...] = STRICT, soft: dict[int, tuple[str, ...]] = SOFT):
    """Vectorised function: addresses -> (strict hits, different soft terms, hundredths). Terms stand between characters
    other than ASCII letters and digits; A-Z count as a-z.

    A strict hit weighs REJECT, each different soft term its own weight; REJECT or more rejects.
    """
    known = weights(strict, soft)
    low_case = {i: i + 32 for i in range(65, 91)}

    @F.pandas_udf("strict long, soft long, weight long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for spelling in known:
            machine.add_word(spelling, spelling)
        machine.make_automaton()
        bound = lambda s, i: i < 0 or i >= len(s) or not (s[i].isascii() and s[i].isalnum())
        for batch in batches:
            rows = []
            for url in batch:
                n, seen = 0, {}
                low = (url or "").translate(low_case)
                for end, spelling in machine.iter(low):
                    if bound(low, end + 1) and bound(low, end - len(spelling)):
                        term, weight = known[spelling]
                        if weight >= REJECT:
                            n += 1
                        else:
                            seen[term] = weight
                rows.append((n, len(seen), n * REJECT + sum(seen.values())))
            yield pd.DataFrame(rows, columns=["strict", "soft", "weight"])

    return count


def judge(pages: DataFrame, rules=RULES, strict: tuple[str, ...] = STRICT, soft: dict[int, tuple[str, ...]] = SOFT) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, strict_hits, soft_terms, weight), one for each row of ``pages`` (page_id, url).

    A rule decides where one fits, else the vocabulary does, counted in the whole address. A null address has empty host
    and path, no hits, and is allowed. Repeated rows and null ids stay; an empty table gives no rows; only the two
    columns are read. No shuffle.
    """
    url = F.col("url")
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), term_counts(strict, soft)(url).alias("hits"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return seen.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("hits.weight") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_terms"), F.col("hits.weight").alias("weight"),
    )


def oracle_sql() -> str:
    """The same judgement in DuckDB SQL: separators are doubled, so that neighbouring terms do not share one."""
    fold = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    seek = lambda t: "[^a-z0-9](" + "|".join(x.replace("-", "--").replace("_", "__") for x in spellings(t)) + ")[^a-z0-9]"
    strict = " + ".join(f"len(regexp_extract_all(v, '{seek(t)}'))" for t in STRICT)
    has = {t: f"CAST(regexp_matches(v, '{seek(t)}') AS BIGINT)" for terms in SOFT.values() for t in terms}
    soft = " + ".join(has.values())
    weight = " + ".join(f"{w} * ({' + '.join(has[t] for t in terms)})" for w, terms in SOFT.items())
    whens = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in whens]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    return f"""
    WITH parts AS (
      SELECT page_id,
        {fold("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
        '#' || regexp_replace({fold("coalesce(url, '')")}, '([^a-z0-9])', '\\1\\1', 'g') || '#' AS v
      FROM pages),
    hits AS (SELECT page_id, host, path, CAST({strict} AS BIGINT) AS strict_hits, CAST({soft} AS BIGINT) AS soft_terms, CAST({weight} AS BIGINT) AS soft_weight FROM parts)
    SELECT page_id, host, path, CASE {rule} END AS rule,
      CASE {verdict} WHEN strict_hits >= 1 OR soft_weight >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict,
      strict_hits, soft_terms, {REJECT} * strict_hits + soft_weight AS weight
    FROM hits"""
