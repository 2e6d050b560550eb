"""Dictionaries of categories and of what gives a few people an advantage. Each line is

phrase = weight + any of these must be there too - none of these may be there
"""

from __future__ import annotations

# Phrases by category of a market.
CATEGORIES = {
    "politics": """
        election = 25
        presidential election = 20
        prime minister = 30
        parliament = 20
        senate = 20 + vote, bill, race, seat
        ballot = 20
        referendum = 30
        approval rating = 25
        impeachment = 35
        cabinet = 20 + minister, reshuffle - kitchen
        running mate = 30
        primary = 15 + candidate, delegate - school, colour
        coalition = 20 + government, party
        swing state = 30
    """,
    "geopolitics": """
        ceasefire = 35
        peace treaty = 35
        sanctions = 25
        border dispute = 30
        troops = 25 + border, deploy, withdraw
        missile = 25 - game
        nuclear deal = 35
        annexation = 35
        embassy = 20
        airspace = 20 + violation, closed
        security council = 30
        no fly zone = 35
        hostages = 25
    """,
    "regulation": """
        antitrust = 35
        approval = 15 + drug, merger, regulator
        drug approval = 35
        regulator = 20
        rule making = 25
        licence revoked = 30
        consent decree = 35
        supreme court = 30
        ruling = 15 + court, judge
        class action = 25
        settlement = 15 + lawsuit, court, fine
        compliance deadline = 35
        exchange listing = 25 + fund, token
    """,
    "economy": """
        interest rate = 30
        rate cut = 30
        central bank = 25
        inflation = 25
        recession = 25
        unemployment = 20
        payrolls = 25
        gross domestic product = 35
        debt ceiling = 35
        credit rating = 25
        trade deficit = 25
        yield curve = 25
    """,
    "technology": """
        product launch = 25
        operating system = 20
        data breach = 30
        language model = 25
        chip = 15 + foundry, export, shortage
        outage = 20
        open source = 15
        self driving = 25
    """,
    "sports": """
        championship = 25
        world cup = 35
        transfer window = 30
        play off = 20
        gold medal = 30
        grand slam = 30 - election
        relegation = 30
        injury report = 25
    """,
    "hardware": """
        bolt = 30
        gear = 30
        rod = 25
        anvil = 35
        old anvil = 20
        large gear = 15
        plate = 20 - hot, cold
    """,
    "gadgets": """
        gizmo = 35
        widget = 35
        new gizmo = 25
        small widget = 15
        red widget = 10
    """,
    "jewellery": """
        ring = 35 + red, blue, small, old
        red ring = 30
        ring = 10 - large
    """,
    "kitchen": """
        plate = 25 + hot, cold
        hot plate = 45
        cold plate = 30
    """,
}
# Phrases that few people hear of first, and signs that some know more than others.
ADVANTAGES = {
    "keyword": """
        merger talks = 25
        unannounced = 20
        clinical trial = 25
        earnings = 15
        earnings = 10 + guidance, warning
        board meeting = 20
        resignation = 20
        indictment = 25
        nomination = 20
        new gizmo = 25
        hot gear = 15
        old anvil = 10
        ring = 5 + red, blue
    """,
    "asymmetry": """
        insider = 20
        leak = 15 - water, gas
        sources say = 15
        closed door = 15
        embargo = 10
        private vote = 15
        blue widget = 15
        cold rod = 10
    """,
}
# Points that a category starts with.
BASE = {"politics": 20, "geopolitics": 30, "regulation": 35, "economy": 20, "technology": 25, "sports": 10, "hardware": 5, "gadgets": 15, "jewellery": 10, "kitchen": 5}
OTHER = 10


def patterns(dictionary: dict[str, str]) -> list[tuple[str, str, float, list[str], list[str]]]:
    """tag, phrase, weight, context and never of each line."""
    out = []
    for tag, lines in dictionary.items():
        for line in filter(None, map(str.strip, lines.splitlines())):
            rest, _, never = line.partition(" - ")
            rest, _, context = rest.partition(" + ")
            phrase, _, weight = rest.partition(" = ")
            words = lambda x: [w.strip() for w in x.split(",") if w.strip()]
            out.append((tag, phrase, float(weight), words(context), words(never)))
    return out
