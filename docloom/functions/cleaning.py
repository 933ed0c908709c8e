"""Cleaning of scraped pages in Markdown: menus, embeds, calls to subscribe, links and repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that do not show, and what stands for them.
INVISIBLE = [("\u00ad", ""), ("\u200b", ""), ("\u200c", ""), ("\u200d", ""), ("\ufeff", ""), ("\u00a0", " ")]
#: Patterns taken out before the phrases, in this order.
MARKUP = [
    r"!\[[^\]]*\]\([^)]*\)",
    r"(?m)^\s*https?://[^\s]+\.(jpg|jpeg|png|gif|svg|webp)[^\s]*\s*$",
    r"\[\]\([^)]*\)",
    r"(?m)^\[(Accueil|Home)\][^\n]*\n",
    r"(?m)^\s*(\[\d+\]\([^)]+\)\s*)+\s*$",
    r"(?s)\[Episode \d+ / \d+.*?de lecture\]\([^)]+\)",
]
#: What players of embedded videos show.
PLAYER = [
    "Watch later", "Share", "Copy link", "Watch on", "If playback doesn't begin shortly", "try restarting your device", "You're signed out",
    "Videos you watch may be added", "TV's watch history", "influence TV recommendations", "To avoid this, cancel and sign in", "CancelConfirm",
    "Include playlist", "An error occurred while retrieving sharing information", "Please try again later", "Tap to unmute", "Info\n\nShopping", "Search\n\nInfo",
]
#: Times, and marks of live videos.
TIMES = r"\d+:\d+\s*/\s*\d+:\d+|\b\d+:\d{2}\b"
LIVE = ["•Live•", "•Live", "Live•"]
#: What newsletters ask for.
NEWSLETTER = [
    "Subscribe to our newsletter", "Our weekly newsletter", "weekly newsletter", "SUBSCRIBE", "Sign up and receive", "We could not confirm your subscription",
    "Your subscription is confirmed", "Please enter your email address", "I agree to receive your emails", "privacy policy", "legal notices",
    "Abonnez-vous à notre newsletter", "Notre newsletter hebdomadaire", "newsletter hebdomadaire", "hebdomadaire hebdomadaire", "JE M'ABONNE", "Inscrivez-vous et recevez",
    "Nous n'avons pas pu confirmer votre inscription", "Votre inscription est confirmée", "Veuillez renseigner votre adresse email", "J'accepte de recevoir vos e-mails",
    "politique de confidentialité", "mentions légales",
]
#: Headings around an article.
SECTIONS = [
    "Other episodes:", "In the same topic:", "Discover the other episodes in this series", "Our selection of series", "Support reliable information", "based on the scientific method", "Donate",
    "Autres épisodes :", "Dans la même thématique :", "Découvrez les autres épisodes de ce dossier", "Notre sélection de dossiers", "Soutenez une information fiable", "basée sur la méthode scientifique", "Faire un don",
]
#: Patterns taken out after the phrases, in this order.
HINTS = [r"(?m)\[←[^\]]*\]\([^)]+\)|\[→[^\]]*\]\([^)]+\)", r"π\s*[^π\n]+", r"\d+\s*(épisodes?|episodes?)", r"\d+\s*min\.\s*(de\s*lecture|read)"]
#: Links, their text kept in the second, then what they leave behind.
STANDALONE, LINK = r"(?m)^\s*\[[^\]]+\]\([^)]+\)\s*$", r"\[([^\]]+)\]\([^)]+\)"
LEFTOVERS = [r"\[\s*\]\([^)]*\)", r"(?m)^#{1,6}\s*\**\s*\**\s*$", r"(?m)^\s*[.,;:!?]\s*$"]
#: Titles of other articles.
TITLES = [
    "Comment le quantique change la face du monde",
    "Batteries : les enjeux autour du stockage d'énergie se multiplient",
    "Prix Nobel : quelles applications pour les travaux des derniers lauréats",
]


def steps() -> list[tuple[str, str, str]]:
    """(text or pattern, what, by what group or text) in the order in which cleaning applies them, up to the comparison of lines."""
    gone = lambda kind, values: [(kind, v, "") for v in values]
    return [
        *[("text", x, by) for x, by in INVISIBLE],
        *gone("pattern", MARKUP),
        *gone("text", PLAYER),
        *gone("pattern", [TIMES]),
        *gone("text", [*LIVE, *NEWSLETTER, *SECTIONS]),
        *gone("pattern", HINTS),
        *gone("text", ["\\"]),
        *gone("pattern", [STANDALONE]),
        ("pattern", LINK, "1"),
        *gone("pattern", LEFTOVERS),
        *gone("text", [f"**{t}**" for t in TITLES]),
        *gone("pattern", [rf"(?m)^\s*\Q{t}\E\s*$" for t in TITLES]),
    ]


def strip(text: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_scraped(text: Column) -> Column:
    """A scraped page's Markdown without what is not its article; null stays null.

    Only \\n ends a line and classes are those of Unicode. Of equal lines in a
    row the first stays; blank lines all stay until runs of them are cut.
    """
    for kind, what, by in steps():
        text = F.replace(text, F.lit(what), F.lit(by)) if kind == "text" else F.regexp_replace(text, f"(?dU){what}", f"${by}" if by else "")
    rows = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    same = lambda all_: F.filter(all_, lambda x, i: (x["bare"] == "") | (i == 0) | (F.get(all_, i - 1)["bare"] != x["bare"]))
    kept = F.transform(F.array(rows), lambda all_: F.array_join(F.transform(same(all_), lambda x: x["line"]), "\n"))[0]
    return strip(F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"(?dUm)^\s+$", ""))
