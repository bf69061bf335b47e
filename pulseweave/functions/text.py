"""Token, word and markup columns.

Character classes are spelled with Unicode properties because Java's ``\\w`` and
``\\s`` are ASCII only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"
NOT_TOKEN_CHAR = r"[^\p{L}\p{N}_\s@#]"
WORD_RUN = r"([\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*)"

# Words that never count as content, English, without apostrophes,
# with the two markup leftovers of short posts at the end.
STOPWORDS_EN = tuple(
    """
    a about above after again against all am an and any are arent as at be because
    been before being below between both but by cant cannot could couldnt did didnt
    do does doesnt doing dont down during each few for from further had hadnt has
    hasnt have havent having he hed hell hes her here heres hers herself him himself
    his how hows i id ill im ive if in into is isnt it its itself lets me more most
    mustnt my myself no nor not of off on once only or other ought our ours ourselves
    out over own same shant she shed shell shes should shouldnt so some such than
    that thats the their theirs them themselves then there theres these they theyd
    theyll theyre theyve this those through to too under until up very was wasnt we
    wed well were weve werent what whats when whens where wheres which while who whos
    whom why whys with wont would wouldnt you youd youll youre youve your yours
    yourself yourselves rt amp
    """.split()
)

# Common Arabic function words plus the two markup leftovers.
STOPWORDS_AR = tuple(
    """
    في من على الى إلى عن مع هذا هذه ذلك تلك التي الذي الذين هو هي هم نحن انا أنا انت
    أنت كان كانت يكون قد لقد لم لن لا ما ماذا كل بعض غير بين بعد قبل عند حتى اذا إذا
    ان أن إن او أو ثم كما لكن حيث اي أي فقط منذ خلال ضد rt amp
    """.split()
)

STOPWORDS = {"en": STOPWORDS_EN, "ar": STOPWORDS_AR, "ru": ()}


def is_special(word: Column) -> Column:
    """Empty, tagged with # or @ at either end, or all digits."""
    return (F.length(word) == 0) | word.rlike(r"^[#@]|[#@]$|^\p{Nd}+$")


def is_url(word: Column) -> Column:
    return (F.length(word) > 4) & (word.startswith("http") | word.startswith("www"))


def flat_spaces(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def _screen(
    tokens: Column, min_len: int, special: bool, url: bool, stop: Iterable[str], unique: bool
) -> Column:
    stop = list(stop)

    def keep(word: Column) -> Column:
        cond = F.length(word) >= min_len
        if special:
            cond = cond & ~is_special(word)
        if url:
            cond = cond & ~is_url(word)
        if stop:
            cond = cond & ~word.isin(stop)
        return cond

    kept = F.filter(tokens, keep)
    return F.array_distinct(kept) if unique else kept


def tokenize_en(
    text: Column,
    drop_special: bool = True,
    drop_url: bool = True,
    drop_stop: bool = True,
    unique: bool = True,
    stopwords: Iterable[str] = STOPWORDS_EN,
) -> Column:
    """English content words of a post, longer than two characters."""
    cleaned = F.regexp_replace(flat_spaces(F.lower(text)), NOT_TOKEN_CHAR, "")
    return _screen(
        F.split(F.trim(cleaned), " "),
        3,
        drop_special,
        drop_url,
        stopwords if drop_stop else (),
        unique,
    )


def tokenize_words(
    text: Column,
    drop_special: bool = True,
    drop_url: bool = True,
    unique: bool = True,
    stopwords: Iterable[str] = (),
) -> Column:
    """Unicode word runs of a post in a language without the English rules.

    Tags, mentions and numbers are dropped before the words are cut.
    """
    flat = flat_spaces(F.lower(text))
    if drop_special:
        flat = F.array_join(F.filter(F.split(flat, " "), lambda w: ~is_special(w)), " ")
    words = F.regexp_extract_all(flat, F.lit(WORD_RUN), 1)
    return _screen(words, 2, False, drop_url, stopwords, unique)


def tokenize(text: Column, lang: Column, **flags: bool) -> Column:
    """Tokens by language: English, Arabic and Russian; others have none."""
    word_flags = {k: v for k, v in flags.items() if k in ("drop_special", "drop_url", "unique")}
    drop_stop = flags.get("drop_stop", True)
    return (
        F.when(lang == "en", tokenize_en(text, **flags))
        .when(
            lang == "ar",
            tokenize_words(text, stopwords=STOPWORDS_AR if drop_stop else (), **word_flags),
        )
        .when(lang == "ru", tokenize_words(text, **word_flags))
        .otherwise(F.array().cast("array<string>"))
    )


def is_scoreable(tokens: Column) -> Column:
    """More than two tokens that are no URLs."""
    return F.size(F.filter(tokens, lambda w: ~is_url(w))) > 2


def display_tokens(text: Column, lang: Column) -> Column:
    """Tokens as shown to people: tags kept, nothing screened out."""
    hash_split = F.regexp_replace(flat_spaces(F.lower(text)), "#", " #")
    english = F.filter(F.split(F.trim(hash_split), " "), lambda w: w != "")
    arabic = F.filter(
        F.regexp_extract_all(F.regexp_replace(text, "#", " #"), F.lit(WORD_RUN), 1),
        lambda w: F.length(w) > 1,
    )
    return (
        F.when(lang == "en", english)
        .when(lang == "ar", arabic)
        .otherwise(F.array().cast("array<string>"))
    )


# Fixed value: the ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def word_kind(word: Column) -> Column:
    return (
        F.when(word.startswith("#"), "hashtag")
        .when(word.startswith("@"), "mention")
        .when(word.startswith("http") | word.startswith("www"), "url")
        .otherwise("word")
    )


def url_of(word: Column) -> Column:
    """Link text of a url token; bare ``www`` hosts get a scheme."""
    return F.when(word.startswith("www"), F.concat(F.lit("http://"), word)).otherwise(word)


# Named character references resolved when markup is stripped.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&amp;", "&"),
)


def html_to_text(html: Column) -> Column:
    """Plain text of a page: no scripts, styles, comments or tags; spaces folded."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, mark in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(out, r"[\s\p{Z}]+", " "))


def meta_content(html: Column, attribute: str, name: str) -> Column:
    """Content of the first ``<meta attribute="name">`` tag, null if there is none."""
    tag = F.regexp_extract(
        html, rf"(?is)<meta\b[^>]*\b{attribute}\s*=\s*[\"']{name}[\"'][^>]*>", 0
    )
    content = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(content != "", content)


def host_of(url: Column) -> Column:
    return F.replace(F.try_parse_url(url, F.lit("HOST")), F.lit("www."), F.lit(""))


# Address patterns of the post network's pages.
PROFILE_PREFIX = "https://twitter.com/"


def profile_url(screen_name: Column) -> Column:
    return F.concat(F.lit(PROFILE_PREFIX), screen_name)


def status_url(screen_name: Column, post_id: Column) -> Column:
    return F.concat(F.lit(PROFILE_PREFIX), screen_name, F.lit("/statuses/"), post_id)
