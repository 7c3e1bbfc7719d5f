"""Values that results depend on: axes, lexicon, slots, line-ups, phrases, word lists."""

from __future__ import annotations

# The axes of a mood vector, in order.
AXES = ("valence", "energy", "warmth", "tension", "depth", "romance", "mystery", "nostalgia", "hope", "melancholy", "wonder", "humor")

# Words that are left out of TF-IDF.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "want", "find", "story", "about", "something")

# Mood words and what each adds to which axis.
LEXICON = {
    "rainy": {"melancholy": 0.5, "warmth": 0.4, "nostalgia": 0.4, "energy": -0.5, "humor": -0.2},
    "sunday": {"nostalgia": 0.4, "warmth": 0.3, "melancholy": 0.2, "energy": -0.3},
    "heartbreak": {"melancholy": 0.7, "warmth": 0.3, "romance": 0.5, "valence": -0.4, "hope": -0.3},
    "breakup": {"melancholy": 0.6, "romance": 0.4, "warmth": 0.2, "valence": -0.3, "hope": -0.3},
    "lonely": {"melancholy": 0.5, "warmth": 0.3, "romance": 0.2, "energy": -0.3},
    "crying": {"melancholy": 0.6, "energy": -0.5, "hope": -0.2},
    "cozy": {"warmth": 0.6, "energy": -0.3, "humor": 0.2, "nostalgia": 0.3},
    "comfort": {"warmth": 0.6, "nostalgia": 0.4, "hope": 0.3, "energy": -0.3},
    "soft": {"warmth": 0.5, "energy": -0.4, "tension": -0.3},
    "quiet": {"energy": -0.6, "tension": -0.4, "warmth": 0.3},
    "slow": {"energy": -0.5, "depth": 0.2},
    "happy": {"valence": 0.6, "hope": 0.4, "humor": 0.3, "energy": 0.3},
    "joyful": {"valence": 0.7, "hope": 0.5, "energy": 0.4},
    "fun": {"humor": 0.6, "energy": 0.4, "valence": 0.5},
    "funny": {"humor": 0.7, "valence": 0.4},
    "uplifting": {"hope": 0.6, "valence": 0.5, "energy": 0.3},
    "inspiring": {"hope": 0.7, "wonder": 0.4, "energy": 0.3},
    "hopeful": {"hope": 0.7, "valence": 0.3, "melancholy": -0.3},
    "dark": {"warmth": -0.5, "valence": -0.4, "tension": 0.4, "depth": 0.3},
    "brooding": {"tension": 0.4, "melancholy": 0.4, "warmth": -0.3, "energy": -0.2},
    "bleak": {"hope": -0.5, "valence": -0.4, "warmth": -0.3, "melancholy": 0.3},
    "intense": {"energy": 0.6, "tension": 0.5, "depth": 0.2},
    "scary": {"tension": 0.7, "energy": 0.3, "warmth": -0.3},
    "spooky": {"mystery": 0.5, "tension": 0.5, "warmth": -0.2},
    "thrilling": {"tension": 0.7, "energy": 0.5},
    "suspenseful": {"tension": 0.7, "mystery": 0.4},
    "mysterious": {"mystery": 0.7, "depth": 0.3, "tension": 0.2},
    "exciting": {"energy": 0.6, "tension": 0.3, "valence": 0.3},
    "adventurous": {"energy": 0.5, "wonder": 0.5, "hope": 0.3},
    "epic": {"energy": 0.7, "wonder": 0.6, "depth": 0.3},
    "romantic": {"romance": 0.8, "warmth": 0.5, "hope": 0.3},
    "love": {"romance": 0.6, "warmth": 0.5, "hope": 0.3},
    "lovey": {"romance": 0.7, "warmth": 0.6, "hope": 0.4},
    "yearning": {"romance": 0.6, "melancholy": 0.4, "nostalgia": 0.3},
    "longing": {"romance": 0.5, "melancholy": 0.5, "nostalgia": 0.4},
    "deep": {"depth": 0.7, "energy": -0.2},
    "philosophical": {"depth": 0.8, "wonder": 0.4},
    "thoughtful": {"depth": 0.6, "energy": -0.2, "warmth": 0.2},
    "meaningful": {"depth": 0.6, "hope": 0.3, "wonder": 0.3},
    "reflective": {"depth": 0.6, "melancholy": 0.3, "nostalgia": 0.3},
    "introspective": {"depth": 0.7, "melancholy": 0.3, "energy": -0.3},
    "nostalgic": {"nostalgia": 0.7, "warmth": 0.3, "melancholy": 0.3},
    "childhood": {"nostalgia": 0.8, "warmth": 0.4, "hope": 0.3},
    "memory": {"nostalgia": 0.7, "depth": 0.4, "melancholy": 0.3},
    "remember": {"nostalgia": 0.6, "melancholy": 0.3},
    "miss": {"nostalgia": 0.6, "melancholy": 0.4, "warmth": 0.3},
    "wonder": {"wonder": 0.7, "humor": -0.2, "hope": 0.3},
    "magical": {"wonder": 0.7, "warmth": 0.3},
    "awe": {"wonder": 0.8, "depth": 0.3},
    "space": {"wonder": 0.7, "mystery": 0.4},
    "ocean": {"wonder": 0.6, "warmth": 0.3, "energy": -0.2},
    "nature": {"wonder": 0.5, "warmth": 0.4, "tension": -0.3},
    "cozy game": {"warmth": 0.7, "energy": -0.4, "nostalgia": 0.3},
    "cottagecore": {"warmth": 0.7, "nostalgia": 0.4, "energy": -0.3},
    "farming": {"warmth": 0.5, "energy": -0.2, "hope": 0.3},
    "wholesome": {"warmth": 0.7, "hope": 0.5, "humor": 0.3},
}

# Weekend slots in order, the types each takes, and its targets.
SLOTS = [
    ("Friday night — settle in", ["movie"], {"warmth": 0.7, "energy": 0.4, "mystery": 0.3}),
    ("Saturday morning — slowly", ["book", "podcast"], {"warmth": 0.7, "nostalgia": 0.6, "energy": 0.3}),
    ("Saturday afternoon — go deeper", ["book", "game"], {"depth": 0.7, "wonder": 0.6, "energy": 0.5}),
    ("Saturday evening — main event", ["movie"], {"valence": 0.6, "depth": 0.7, "wonder": 0.5}),
    ("Sunday morning — quiet", ["podcast", "book"], {"nostalgia": 0.6, "warmth": 0.7, "energy": 0.3}),
    ("Sunday afternoon — playful", ["game"], {"humor": 0.7, "hope": 0.6, "warmth": 0.7}),
    ("Sunday night — landing", ["podcast", "movie"], {"nostalgia": 0.6, "melancholy": 0.4, "warmth": 0.7}),
]

# Festivals, their taglines and the axes they lean to.
FESTIVALS = [
    ("The Lonely Sundays Festival", "Three days for quiet grief, slow coffee, and the books that make you cry in a good way.", {"melancholy": 0.7, "warmth": 0.6, "nostalgia": 0.7, "energy": 0.3, "romance": 0.4}),
    ("The Wonder Engine Festival", "Awe-soaked hours of strange skies, deep sea, and big questions.", {"wonder": 0.85, "depth": 0.7, "mystery": 0.5, "energy": 0.5}),
    ("The Big Hug Festival", "Wholesome, hopeful, and gently funny — the cinematic equivalent of a friend's couch.", {"warmth": 0.85, "hope": 0.8, "humor": 0.6, "nostalgia": 0.5, "valence": 0.7}),
    ("The Knife-Edge Festival", "Taut, twisty, and dark. Best consumed in one sitting with the lights low.", {"tension": 0.85, "mystery": 0.8, "depth": 0.7, "warmth": 0.3, "valence": 0.35}),
    ("The Late-Night Longing Festival", "For 2 a.m. — yearning, romance, and a window you keep looking out of.", {"romance": 0.8, "melancholy": 0.6, "nostalgia": 0.6, "warmth": 0.6, "energy": 0.3}),
]

# Items of each type in a festival.
LINEUP = (("movie", 2), ("book", 1), ("game", 1), ("podcast", 1))

# What an axis says when high, and when low.
PHRASES = {
    "valence": ("leaning toward the warm side of the emotional spectrum", "sitting in the hard, honest end of feeling"),
    "energy": ("buzzy and propulsive", "slow-burn and unhurried"),
    "warmth": ("deeply human and affectionate", "cool, distant, a little austere"),
    "tension": ("taut with suspense", "calm and free of pressure"),
    "depth": ("asks something real about being alive", "easy, surface-level fun"),
    "romance": ("threads love right through the center", "not really about love"),
    "mystery": ("keeps you guessing", "doesn't really hide things"),
    "nostalgia": ("smells like an old year", "firmly anchored in the present"),
    "hope": ("ends on the side of light", "unflinching about how bleak it can get"),
    "melancholy": ("carries a real ache", "doesn't lean on sadness"),
    "wonder": ("strange and awe-filled", "rooted in the everyday"),
    "humor": ("funny in a way that lands", "mostly plays it straight"),
}

# Media types and their signs.
TYPES = ("movie", "book", "podcast", "game", "music")
EMOJI = {"movie": "🎬", "book": "📖", "podcast": "🎧", "game": "🎮", "music": "🎵"}
NO_EMOJI = "✨"

# Columns that identify a post or hold its text, in order; columns that come first in an export.
URL_KEYS = ("postUrl", "post_url", "postLink", "post_link", "url", "link")
TEXT_KEYS = ("text", "content", "postText", "description", "message")
FALLBACK_KEYS = ("timestamp", "date", "author", "groupName")
FIRST_COLUMNS = (
    "author", "name", "timestamp", "date", "postUrl", "post_url", "postLink", "post_link", "text", "content", "description",
    "groupName", "group", "source_file",
)
ENVELOPE_KEYS = ("posts", "data", "results", "items")

# Endings of direct audio files; words that pad a short keyword list.
AUDIO_ENDINGS = (".mp3", ".wav", ".m4a", ".ogg")
PADDING = ("story", "mood", "drama")


# What a listing must say, and what is read from it. (?U) lets blanks, digits and word borders be those of all
# scripts, no-break spaces among them.
RENT = r"(?iU)Rent\s*:\s*[₹Rs. ]*([0-9][0-9,]*)"
KIND = r"(?iU)\b([234])\s*BHK\b"
MONTHS = r"(?iU)\b(?:July|August)\s+2026\b"
PLACE = r"(?iU)(?:Location|Society|Address)\s*:\s*([^\n]+)"
BATHROOM = "(?i)attached bathroom|private bathroom"
SHARED_BATHROOM = "(?i)shared.*(?:washroom|bathroom)|(?:washroom|bathroom).*shared"
CONTACT = r"(?:\+91[- ]?)?[6-9][0-9]{9}"

# What stands where a listing says nothing.
NO_PLACE, NO_BATHROOM, NO_CONTACT = "Not stated", "Not stated", "Not stated"

# A word of a request; the metadata tail and the tags that a preview leaves out.
KEYWORD = "[A-Za-z][A-Za-z'-]{2,}"
METADATA_TAIL = r"(?i)\n\s*(?:---\s*)?metadata(?:\s*---)?\s*:?[\s\S]*$"
DIV_TAG = r"(?i)</?div\b[^>]*>"

# Parts of the paragraph on an item, and of the recommendation without a model.
LINED_UP = " — which lines up with what you said you wanted."
FALLBACK_PITCH = " is a strong match for the mood you described. Start here for a story shaped around that feeling."
FALLBACK_REASON, FALLBACK_THEMES = "It matches your request for ", "Its themes include "

# Namespaces of Office Open XML and SpreadsheetML.
OFFICE = "http://schemas.openxmlformats.org"
SPREADSHEET = "urn:schemas-microsoft-com:office:spreadsheet"
