"""Residue and harmless sentences that no model is fitted on, each within a paragraph of plain news.

Written before the grammars of residue_examples.py were widened, by the same hand; nothing here stands among the examples.
"""

import os

import pandas as pd
import pytest

from strandloom.llm import residue
from tests_llm_tables import natural_tables

RESIDUES = {
    "template": [
        "{{article.lede_paragraph}}", "*|FNAME|*", "[% story.body %]", "{{#each sections}}", "<%= article.standfirst %>",
        "%%SUBSCRIBER_NAME%%", "${weather.outlook}", "@@EDITION@@", "{% include 'masthead.html' %}", "{{{raw_copy}}}",
        "[INSERT WEATHER FORECAST]", "<<Reporter>>", "%(place)s", "[Your Surname Here]", "{!Contact.FirstName}",
        "[[picture_caption]]", "$ISSUE_NUMBER$", "##PRICE_PER_COPY##", "{{ advert.slot_3 | safe }}", "<?= $row['heading'] ?>",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt.",
        "Nunc viverra imperdiet enim, fusce est, vivamus a tellus, pellentesque habitant morbi tristique.",
        "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
        "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.",
        "Etiam porta sem malesuada magna mollis euismod. Cras mattis consectetur purus sit amet fermentum.",
        "asdf jkl asdf asdf jkl asdfasdf jkljkl asdf fdsa asdf jkl", "qwerty qwerty asdfgh zxcvbn qwerty asdfgh qwerty",
        "blah blah blah blah blah blah blah blah blah", "test test test test test test test test test",
        "Your article text goes here. Replace this paragraph with your own words.",
        "This is some sample copy. This is some sample copy. This is some sample copy.",
        "Placeholder text. Placeholder text. Placeholder text. Placeholder text.",
        "Xxxxx xxxx xx xxxxxxx xxx xxxx xxxxxxxxx xx xxxx xxxxx.", "TEXT TEXT TEXT TEXT TEXT TEXT TEXT TEXT",
        "Add your text here. Click to edit this paragraph and add your own content.",
        "Curabitur blandit tempus porttitor. Nullam quis risus eget urna mollis ornare vel eu leo.",
        "Aenean lacinia bibendum nulla sed consectetur. Donec sed odio dui, vestibulum id ligula porta.",
        "foo bar baz foo bar baz foo bar baz foo bar baz", "Dummy content for layout purposes only, to be replaced before printing.",
        "Hier steht ein Blindtext. Hier steht ein Blindtext. Hier steht ein Blindtext.",
    ],
    "notice": [
        "HTTP ERROR 410 Gone. This resource is no longer available at this address.",
        "Bandwidth Limit Exceeded. The server is temporarily unable to service your request.",
        "Error establishing a database connection.", "This site can't be reached. The server took too long to respond.",
        "502 Bad Gateway nginx/1.18.0", "Fatal error: Call to undefined function get_header() in /var/www/html/index.php on line 12",
        "You need to have JavaScript turned on in order to use this website.",
        "This website requires JavaScript to be enabled in your browser.", "Service Temporarily Unavailable. Please try again in a few minutes.",
        "We're sorry, but this app doesn't work properly without JavaScript enabled.",
        "Whoops, looks like something went wrong. Please refresh the page and try again.",
        "The page you requested does not exist or has been removed.", "JavaScript seems to be disabled in your browser.",
        "429 Too Many Requests. You have sent too many requests in a given amount of time.",
        "Traceback (most recent call last): File \"app.py\", line 44, in render",
        "Access to this resource on the server is denied.", "Uncaught ReferenceError: article is not defined",
        "Request Timeout. The server timed out waiting for the request from the browser.",
        "Please turn on scripting and reload this page to see the content.",
        "Diese Website benötigt JavaScript. Bitte aktivieren Sie JavaScript in Ihren Browsereinstellungen.",
    ],
}
HARMLESS = [
    "[see over]", "<Sir> and <Madam> were the words upon the two doors.", "The bill came to $4.50, and the change to 50 cents.",
    "The old gateway on the turnpike was bad, and carts could not pass.", "He took seat No. 404 in the gallery and did not complain.",
    "The servers at the banquet were found to be unable to carry more.", "A script for the Christmas play has been requested by the school.",
    "The captain's request was denied by the harbour board.", "The word blah was heard once from the back of the hall.",
    "Dummy rifles were used by the volunteers at Saturday's drill.", "The sample of barley was the best text for his sermon.",
    "Latin prose was set for the scholarship: Caesar, Book IV.", "Et tu, Brute, cried the clerk, when his friend voted against him.",
    "(Continued on page 4.)", "Wanted, a cook {plain}; apply at the office.", "Tea, 1s. 6d. per lb.; sugar, 4d.; soap, 3d.",
    "The connection with the evening train was missed on Friday.", "An error in Tuesday's issue is regretted: for Smith read Smyth.",
    "The tenants were refused, and their lease timed out at Michaelmas.", "He could not be found at the hour of trial.",
    "A notice was posted that the bridge is closed for repairs.", "Please shut the gate, said the sign, and keep dogs away.",
    "The lamp would not load properly into the cart.", "The page to the sheriff was thrown from his horse.",
    "Access to the pier is denied to cyclists after dusk.", "The council went too fast and the motion was lost.",
    "Your humble servant, [signed] A Ratepayer.", "The council will try again later in the year, we hear.",
    "A test match was played at the old ground.", "The foreign mail is overdue; no news of the barque.",
    "The lecture on electric currents required a dark room.", "Temporary repairs are required before the hall can be used.",
    "The exception proves the rule, remarked the chairman.", "The keyboard of the organ was repaired by Mr Hale.",
    "Enter your hounds by noon, runs the notice of the show.", "Insert the key gently, the locksmith advised.",
    "The vicar spoke of the fatal error of pride.", "Internal strife has broken the club in two.",
    "The gate of the lock was opened & the barge [the Ann] went through.", "Item 3: drains. Item 4: lamps. Item 5: a new pump.",
    "Scripture was read by the dean.", "Shares: Gas 104%, Water 98%, Tram 55%.", "Mr B---- was named in the petition.",
    "The score stood at 3-0 (half-time 1-0).", "No. 12 / 14, High Street, to let; apply within.", "Found, a purse; owner may have it by proof.",
    "The lady was not at home to callers.", "Cattle: 40 sold; sheep: 112; pigs: 9.", "The train of 9:15 is withdrawn until Monday.",
    "Too many cooks were requested, and the broth was spoiled.", "The bad boy threw stones at the gateway lamp.",
    "The host could not be reached for an answer.", "The audience was asked to refresh itself in the tea tent.",
    "The magistrate wanted the name of the reader.", "Author of the pamphlet unknown; publisher fined 5 pounds.",
    "The site for the new baths has been moved to the south bank.", "An application for a spirit licence was refused.",
    "His browser of goats, as he called the hedge, was stripped bare.", "The service at St Mary's was unavailable to the infirm.",
    "The document was sealed * and signed by both parties.",
]
PROSE = "The tide ran late at Wenford and the market was quiet. {} Prices of barley were steady, and the bench rose at four."


@pytest.fixture(scope="module")
def tables(data):
    return natural_tables(os.path.join(os.path.dirname(data), "sf0.01"))


def test_held_out_wording(spark, tables):
    cases = [(k, t) for k, ts in RESIDUES.items() for t in ts] + [(None, t) for t in HARMLESS]
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(cases)), "text": [PROSE.format(t) for _, t in cases]}))
    flagged = {r["id"] for r in residue.residue_spans(df, key="id", text="text", tables=tables).collect()}
    true = {i for i, (k, _) in enumerate(cases) if k}
    found = len(flagged & true)
    print("missed:", [cases[i] for i in sorted(true - flagged)], "false:", [cases[i][1] for i in sorted(flagged - true)])
    assert len(true) >= 60 and len(cases) - len(true) >= 60
    assert found / len(true) >= 0.85 and found / max(len(flagged), 1) >= 0.9
