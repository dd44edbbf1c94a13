"""Fixed values the results depend on.

FIXED VALUES — these must stay exactly as written for results to agree with
the behaviour being reproduced: thresholds, boilerplate phrases, template
line markers, stop words and text patterns.
"""

from __future__ import annotations

import unicodedata

# ---------------------------------------------------------------- FIXED VALUES
# Thresholds.
SENTENCE_SIM_THRESH = 0.44      # a sentence pair matches when its distance is below this
WORD_DISTANCE_CUTOFF = 0.5      # word pairs at or above this are not near; also the missing-word penalty

# Paragraph separator in stored summaries.
PARAGRAPH_SEP = "</p><p>"

# Boilerplate phrases: a sentence whose lower-cased text contains one is dropped.
BOILERPLATE_PHRASES = [
    'Share on WhatsApp',
    'Share on Messenger',
    'Reuse this content',
    'Share on LinkedIn',
    'Share on Pinterest',
    'Share on Google+',
    'Listen /',
    '– Politics Weekly',
    'Sorry your browser does not support audio',
    'https://flex.acast.com',
    '|',
    'Share on Facebook',
    'Share on Twitter',
    'Share via Email',
    'Sign up to receive',
    'This article is part of a series',
    'Follow Guardian',
    'Twitter, Facebook and Instagram',
    'UK news news',
    'Click here to upload it',
    'Do you have a photo',
    'Listen /',
    'Email View',
    'Read more Guardian',
    'This series is',
    'Readers can recommend ',
    'UK news news',
    'Join the debate',
    'guardian.letters@theguardian.com',
    'More information',
    'Close',
    'All our journalism is independent',
    'is delivered to thousands of inboxes every weekday',
    'with today’s essential stories',
    'Newsflash:',
    'You can read terms of service here',
    'Guardian rating:',
    'By clicking on an affiliate link',
    'morning briefing news',
    'Analysis:',
    'Good morning, and welcome to our rolling coverage',
    'South and Central Asia news',
    'f you have a direct question',
    'sign up to the',
    'You can read terms of service here.',
    'If you want to attract my attention quickly, it is probably better to use Twitter.',
    'UK news',
]

# Template lines (case-sensitive): dropped if the sentence starts with, contains
# or ends with one of these.
TEMPLATE_STARTS_WITH = [
    'Updated ',
    'Here’s the sign-up',
    '[Read more on',
    '[Here’s the list of',
    '[Follow our live coverage',
    '[',
]
TEMPLATE_CONTAINS = [
    'Want to get this briefing by email',
    'Thank youTo',
]
TEMPLATE_ENDS_WITH = [
    ']',
]

# Markup lines of scraped pages.
LAST_LINE_PATTERN = r'Currently monitoring (\d|,)+ news articles'
VERSION_LINE_PATTERN = r'Version \d+ of \d+'
FIRST_LINE_LINK_PREFIX = '<p><a href'
ESCAPED_TAG_PATTERN = r'&lt;.*?&gt;'

# Dateline markers: text before the first of these dashes may be a dateline.
DATELINE_DASHES = ['—', '–']
DATELINE_MAX_WORDS = 6          # a dateline has fewer words than this

# English stop words removed from content words.
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "should", "now",
]

# Merge/split alignment of edited clusters.
CONTAINMENT_SLACK = 0.5          # share of words of the shorter sentence allowed to be missing
DIFF_SIMILAR_RATIO = 0.8         # word ratio above which ndiff's -/+ pair is one edited sentence
LOW_OVERLAP_RATIO = 0.2          # arcs under this word overlap are flagged for review

# Markup presets for word diffs.
HTML_MARKS = {
    "old_front": '<span style="background-color:rgba(255,0,0,0.3)">',
    "old_back": '</span>',
    "new_front": '<span style="background-color:rgba(0,255,0,0.3)">',
    "new_back": '</span>',
}
LATEX_MARKS = {
    "old_front": '\\hlpink{',
    "old_back": '}',
    "new_front": '\\hlgreen{',
    "new_back": '}',
}
# ------------------------------------------------------------ END FIXED VALUES

# Our own fixed decisions (not taken from anywhere else).
SENTENCE_PATTERN = r'[^.!?\n]+[.!?]*'     # one sentence: text up to and including its end marks
TOKEN_PATTERN = r'[\p{L}\p{N}]+'          # one word: a run of letters and digits
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _accent_table() -> tuple[str, str]:
    """Latin letters with diacritics -> their ASCII base letter (rule: NFD)."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED_CHARS, ACCENT_BASES = _accent_table()
