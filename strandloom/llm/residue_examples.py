"""Labelled examples of residue, from which its character models are fitted.

The examples are written by hand. Common forms came first; much of the wording
of fillers, notices and CONTRAST was added after reading pages of the sample
tables (the README says which). With FIELDS and FORMS they make a bounded
training sample (see ``examples``).
"""

from __future__ import annotations

import numpy as np

from strandloom.llm.letters import MISREADINGS

#: Names that template fields bear.
FIELDS = (
    "title", "headline", "subtitle", "standfirst", "byline", "author", "editor", "name", "first name", "last name",
    "reader", "subscriber", "customer", "user", "email", "address", "phone", "company", "date", "issue date", "time",
    "price", "amount", "caption", "photo", "photo credit", "image", "image url", "page url", "link", "section",
    "category", "body", "body text", "content", "summary", "description", "column left", "column right", "footer",
    "header", "place name", "city", "region", "region label", "page number", "volume", "newspaper", "job title",
    "staff title", "quote", "teaser", "keywords", "tag", "id", "label", "text", "item", "value",
)
#: The forms of a field that nobody filled; ~ stands for its name.
FORMS = (
    "{{~}}", "{{ ~ }}", "{{ ~|upper }}", "{{ ~|title }}", "{{page.~}}", "{~}", "${~}", "$~$", "$~", "#{~}", "%%~%%", "%~%",
    "__~__", "<<~>>", "<~>", "[~]", "[[~]]", "<~ goes here>", "[~ goes here]", "[insert ~]", "[insert ~ here]",
    "<insert ~ here>", "[~ to follow]", "[~ here]", "[your ~ here]", "<Enter ~>", "[enter ~]", "Type your ~ here",
    "Insert ~ here", "Enter your ~ here", "Your ~ here", "Dear {~},", "Dear [~],", "Dear <~>,", "Dear $~,", "Dear {{~}},",
    "<%= ~ %>", "<%= page.~ %>", "<?= $~ ?>", "<?php echo $~; ?>", "{% block ~ %}{% endblock %}", "{% ~ %}",
    "{% if ~ %}", "~: undefined", "~: null", "~: NaN", "~ TK", "~ TBD", "~: [object Object]", "Name $~$", "@~@",
    "By FIRSTNAME LASTNAME, ~", "By FIRSTNAME LASTNAME, Staff Title", "FIRSTNAME LASTNAME", "[FIRST NAME] [LAST NAME]",
    "*|~|*", "[% ~ %]", "[%~%]", "@@~@@", "{{{~}}}", "{{{ ~ }}}", "{{#if ~}}", "{{#each ~}}", "{{/~}}", "{{> ~}}", "{{ ~ | safe }}", "{{~|trim}}",
    "{% include '~' %}", "{% for x in ~ %}", "{% extends '~.html' %}", "{$~}", "%{~}", "%(~)s", "%[~]%", "{!~}", "[*~*]", "[[$~]]", "<!-- ~ -->",
    "<%- ~ %>", "<%# ~ %>", "<?php the_~(); ?>", "${~}", "#~#", "|~|", "~~", "[TODO: ~]", "[PLACEHOLDER: ~]", "<<INSERT ~>>", "{your ~}", "@{{~}}", "v-~=~",
    "##~##", "***~***", "%s: %s", "%s %d", "@{~}", "xx ~ xx", "XX ~ XX", "$(~)", "Click to add ~", "Click here to add ~", "[add ~]", "[ADD ~]", "TK TK ~ TK", "TK TK TK", "<? $~ ?>", "<% ~ %>", "~: ____", "{~:}",
)
#: Words of filler text in pseudo-Latin.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis "
    "aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat "
    "non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum sagittis pulvinar vitae justo "
    "porta mauris vivamus pellentesque curabitur suspendisse maecenas phasellus nunc fusce tellus imperdiet viverra habitant "
    "tristique senectus netus malesuada fames turpis egestas etiam praesent donec nullam quis risus eget ornare cras mattis purus "
    "fermentum aenean lacinia bibendum sagittis vitae leo orci ligula nibh odio dapibus tortor condimentum euismod rutrum sapien "
    "integer posuere erat ante venenatis proin gravida"
).split()
#: Filler that isn't pseudo-Latin.
FILLER = (
    "xxxx xxx xxxxxx xxxx xxxxxxxx xxx xxxx xxxxxx xxxxxx xxx xxxxxxxx xxxx xxx xxxxxx",
    "xxxxxxxx xxxxxx xxxx xxxx xxx xxx xxxxxx xxxxxxxx xxxxxx xxxx",
    "XXXXX XXXX XXXXXX XXX XXXXXXX XXXX",
    "This is placeholder text. Replace this text with your own copy.",
    "Placeholder copy for position only. Dummy text, final text to come.",
    "Sample text goes here. Sample text goes here.",
    "Dummy text for position only. Dummy text for position only.",
    "Copy to come. Copy to come. Copy to come.",
    "Story text to be supplied. Story text to be supplied.",
    "Body copy goes in this space. Body copy goes in this space.",
    "This is where the article text would go. This is where the article text would go.",
    "Sample paragraph to show the setting. Sample paragraph to show the setting.",
    "Column filler, not for publication. Column filler, not for print.",
    "Paragraph of sample text. Headline text here. Story goes here.",
    "Text to follow. Text to follow. Article text goes here.",
    "Blindtext steht hier anstelle des Artikels. Blindtext steht hier anstelle des Artikels.",
    "Faux texte en attente de la rédaction. Faux texte en attente de la rédaction.",
    "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.",
    "Dies ist ein Blindtext. Blindtext Blindtext Blindtext.",
    "Platzhaltertext, bitte ersetzen. Hier steht Ihr Text.",
    "Texte de remplissage. Votre texte ici. Faux texte provisoire.",
)
#: Words typed to fill room.
KEYS = "test text blah bla asdf qwer zxcv foo bar dummy qwerty".split()
#: The parts of sentences that say of themselves that they fill room.
SAMPLE_STARTS = ("This is", "Here stands", "Insert", "Use", "Only", "Temporary", "Some", "More", "Nothing but", "Please replace this")
SAMPLE_KINDS = ("sample", "dummy", "placeholder", "filler", "example", "test", "mock", "provisional", "stand-in", "blind")
SAMPLE_NOUNS = ("text", "copy", "content", "paragraph", "article", "words", "story", "headline", "caption", "body copy")
SAMPLE_ENDS = (
    "goes here", "to be replaced", "for the layout", "for design purposes only", "before going to press", "until the real text comes",
    "not for publication", "to fill the space", "with your own", "and edit it", "for position only", "to follow later", "",
)
#: Status codes of HTTP with their phrases.
STATUSES = (
    "400 Bad Request", "401 Unauthorized", "402 Payment Required", "403 Forbidden", "404 Not Found", "405 Method Not Allowed",
    "406 Not Acceptable", "408 Request Timeout", "409 Conflict", "410 Gone", "413 Content Too Large", "414 URI Too Long",
    "415 Unsupported Media Type", "423 Locked", "425 Too Early", "429 Too Many Requests", "451 Unavailable For Legal Reasons",
    "500 Internal Server Error", "501 Not Implemented", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout",
    "505 HTTP Version Not Supported", "507 Insufficient Storage", "508 Loop Detected", "509 Bandwidth Limit Exceeded",
    "511 Network Authentication Required", "521 Web Server Is Down", "522 Connection Timed Out", "523 Origin Is Unreachable",
)
#: How servers show a status; ~ stands for it.
STATUS_FORMS = (
    "HTTP ERROR ~", "HTTP/1.1 ~", "Error ~", "~ error", "HTTP Status ~", "Status: ~", "~. nginx/1.0", "~. nginx",
    "~. Apache/2.0 (Ubuntu) Server at Port 80", "~. Microsoft-IIS/10.0", "~. cloudflare Ray ID", "The server responded with ~.", "Server error: ~.",
)
#: The parts of messages of programs, servers and browsers: what, what happened, where.
PROGRAMS = (
    "Fatal error", "Parse error", "Warning", "Notice", "Uncaught Error", "Unhandled exception", "Uncaught SyntaxError", "RuntimeError",
    "TypeError", "NameError", "KeyError", "ValueError", "java.lang.IllegalStateException", "System.NullReferenceException",
    "SQLSTATE[HY000]", "Segmentation fault", "Traceback (most recent call last)", "Unhandled promise rejection",
)
MISHAPS = (
    "undefined variable", "call to undefined method", "undefined index", "cannot read property of null", "is not a function",
    "unexpected token", "unexpected end of input", "out of memory", "maximum execution time exceeded", "no such file or directory",
    "name is not defined", "object reference not set", "failed to open stream", "access denied for user", "division by zero",
    "connection refused", "lost connection to the database", "could not connect to the database", "the database is not responding",
    "syntax error in query", "permission denied",
)
WHERES = (
    "in /var/www/index.php on line 0", "in /srv/app/render.js line 0", "File \"main.py\", line 0, in load", "at Module.render (bundle.js:0:0)",
    "at com.site.Page.load(Page.java:0)", "in module page on line 0", "(core dumped)", "Stack trace:", "",
)
BROWSER = (
    "This site cannot be opened. The server refused to connect.", "The server took too long to answer. ERR_CONNECTION_TIMED_OUT",
    "The server's address could not be found. DNS_PROBE_FINISHED_NXDOMAIN", "Your connection to this site is not private.",
    "The connection was reset while the page was loading.", "Unable to connect to the server. Check the network cables, modem and router.",
    "You do not have access to this resource. Access to the requested resource is forbidden.", "Access to this server was denied.",
    "We could not establish a connection to the database.", "Establishing the database connection failed with an error.",
    "This account has been suspended by the hosting provider.", "The site owner has reached the bandwidth limit. Please try again later.",
    "The service is temporarily unavailable. Please try again in some minutes.", "Something broke. Refresh the page or try again later.",
    "The file you requested does not exist or has been removed from the server.", "Your request timed out. Reload the page.",
)
#: The parts of requests to switch scripts on.
ASKS = ("Please enable", "Please activate", "Please allow", "You must enable", "You need to turn on", "Kindly switch on", "Turn on", "Enable",
        "Make sure you have enabled", "To continue, enable")
SCRIPT_NAMES = ("JavaScript", "Javascript", "JS", "scripts", "scripting", "script support", "client-side scripting", "JavaScript and cookies")
PURPOSES = (
    "in your browser", "in your browser settings", "to continue", "to use this website", "to view this content", "and reload this page",
    "and refresh the page", "to see the full content", "for this website to work", "to use all features of this site", "in order to use this app",
)
PLACES = ("This website", "This site", "This app", "This page", "Our website", "This feature", "This content", "The viewer")
RELIES = ("requires", "needs", "relies on", "does not work without", "will not run without", "depends on", "cannot be displayed without",
          "doesn't work properly without")
#: What a message is about; it stands for @ in the notices.
THINGS = ("page", "archive", "site", "viewer", "zoom tool", "document", "page image", "article", "reel", "scan", "application",
          "issue", "archive page", "text layer", "requested scan")
#: Messages of failed pages and servers; @ is one of THINGS, 0 a number.
ERRORS = (
    "404 Not Found. The @ you asked for does not exist on this server.",
    "Error 404: the @ you requested could not be found.",
    "Error 403: the @ could not be loaded. Please try again later.",
    "403 Forbidden. You do not have permission to access this @ on this server.",
    "Access denied. You do not have permission to view this @. Reference no. 0",
    "500 Internal Server Error. The server encountered an unexpected condition.",
    "502 Bad Gateway. The @ you asked for is not available on this server.",
    "502 Server Error. The @ you asked for does not exist on this server.",
    "503 Service Unavailable. The server is temporarily unable to service your request.",
    "504 Gateway Timeout. The @ did not respond in time.",
    "Oops! Something went wrong on our side. The @ failed to open (code 0).",
    "Sorry, something went wrong. Please reload the @ and try again.",
    "This @ cannot be displayed. An error occurred while loading the @.",
    "The @ could not be loaded. Please try again later.",
    "We are sorry, the @ you are looking for cannot be found or has been moved.",
    "Fatal error: unexpected null value in viewer.render on line 0. Stack trace follows.",
    "Warning: undefined variable in index.php on line 0",
    "Uncaught TypeError: cannot read properties of undefined. Stack trace follows.",
    "Exception in thread main: java.lang.NullPointerException at line 0",
    "@ not found: timeout. Request timed out. Connection refused.",
    "Database connection failed. Please contact the administrator.",
    "Your session has expired. Please log in again to view this @.",
    "Too many requests. Please try again later. Request ID 0",
    "The requested URL was not found on this server.",
    "Fehler 404: Die angeforderte Seite wurde nicht gefunden.",
    "Fehler 500: Interner Serverfehler. Bitte versuchen Sie es später erneut.",
    "Zugriff verweigert. Sie haben keine Berechtigung, diese Seite anzuzeigen.",
    "Die Seite konnte nicht geladen werden. Bitte versuchen Sie es später noch einmal.",
    "Erreur 404. La page demandée est introuvable ou a été déplacée.",
    "Erreur 403. La page demandée est introuvable ou a été déplacée.",
    "Erreur 500 : erreur interne du serveur. Veuillez réessayer plus tard.",
    "Accès refusé. Vous n'avez pas l'autorisation de consulter cette page.",
)
#: The parts of further messages: how they begin, what failed, why, and what to do.
STARTS = (
    "Sorry, but the @", "We regret that the @", "Unfortunately, the @", "Warning! the @", "Alert - the @", "Notice: the @",
    "Error: the @", "Oops! the @", "We are sorry, the @", "Attention! the @",
)
FAILS = (
    "could not be", "failed to be", "can no longer be", "cannot be", "was not", "is not able to be", "has failed to be",
)
DEEDS = (
    "loaded", "found", "opened", "shown", "displayed", "decoded", "rendered", "retrieved", "fetched", "read", "processed",
)
CAUSES = (
    ".", ": timeout.", ": quota reached.", ": unknown host.", " - forbidden.", " - server error.", " [0].", " (code 0).",
    " (reference 0).", " (ref 0).", " - bad gateway.", " - not found.", ": connection reset.", " - bad request.", ": unexpected response.", ". Error 0.",
)
ADVICE = (
    "Go back.", "Go back and try again.", "Contact the help desk.", "Return to the start page or search again.",
    "Check the address.", "Reload the tab.", "Please try again later.", "Report this problem.", "Report this fault.", "Clear your cache.", "Refresh the page.",
    "Contact the administrator.", "Try another browser.", "",
)
STATES = (
    "Sorry, but the @ is no longer available. Return to the start page or search again.",
    "This site is down for maintenance. The @ will be back shortly.",
    "The connection to the image store timed out while fetching the @.",
    "The @ is temporarily down for maintenance. The @ will be back shortly.",
    "This service is closed for maintenance. The @ will be back shortly.",
    "Your session has expired. Sign in again to continue reading this @.",
    "Too many requests have come from your address. Wait 0 seconds before opening another @.",
    "It looks as if scripts are blocked. Disable your blocker to see the @.",
    "Oops! Something went wrong on our side. The @ failed to open (code 0).",
    "Fehler 0: Die angeforderte Seite konnte nicht geladen werden.",
    "Fehler 0: Die angeforderte Seite wurde nicht gefunden.",
    "Erreur 0. La page demandée est introuvable ou a été déplacée.",
    "0 Gateway Timeout. The @ you asked for does not exist on this archive.",
    "0 Not Found. The @ you asked for does not exist on this server.",
)
#: The parts of further notices about scripts: what, its state, for what, and what to do.
ENGINES = (
    "JavaScript", "Java Script", "JS", "Scripts", "Scripting support", "Active scripting", "Client scripts", "Scripting",
)
NEEDS = (
    "is needed", "is required", "must be on", "must be allowed", "must be enabled", "must be switched on",
    "has been turned off", "seems to be blocked", "is disabled", "is switched off", "is not supported by your browser",
    "appears to be off", "needs to be enabled",
)
ENDS = (
    "to read this page.", "to read this @.", "for the @ to load.", "before we can show the @.", "and nothing can be shown.",
    "so the columns cannot be drawn.", "to open this viewer.", "and the @ cannot be shown.", "to use this archive.",
)
THEN = (
    "Switch it on and come back.", "Change your settings.", "See the help page.", "Turn it on in your browser settings and "
    "reload.", "Reload the page.", "Allow it and try again.", "",
)
#: Notices that scripts are needed.
SCRIPTS = (
    "Please enable JavaScript to use this @.",
    "Please enable JavaScript to view this @. Your browser does not support JavaScript.",
    "JavaScript is required. Turn it on in your browser settings and reload to open this @.",
    "JavaScript is disabled in your browser. Please switch it on and reload the @.",
    "Java Script must be allowed to read this @. Change your settings.",
    "You need to enable JavaScript to run this @.",
    "You need to allow scripts and cookies before this @ can start.",
    "You need to allow scripts and cookies before our @ can start.",
    "Your browser has scripting switched off; this @ needs it to show the text.",
    "Scripts is not supported by your browser so the @ cannot be drawn.",
    "Scripting support is needed for the @ to load. Switch it on and come back.",
    "Client scripts seems to be blocked and nothing can be shown. Switch it on and come back.",
    "Active scripting seems to be blocked and nothing can be shown. Change your settings.",
    "Active scripting is disabled for the @ to load.",
    "noscript: This @ cannot run without scripts.",
    "Checking your browser before opening this @. This requires JS and takes a few seconds.",
    "Checking if the site connection is secure. Enable JavaScript and cookies to continue.",
    "This @ works best with scripts turned on. Enable scripts and reload.",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
    "Für diese Seite wird JavaScript benötigt. Bitte schalten Sie es in Ihrem Browser ein.",
    "Vous devez activer JavaScript pour afficher cette page.",
    "Veuillez activer JavaScript dans votre navigateur pour utiliser ce site.",
)
#: Newspaper text that speaks of such things, as examples of what is no residue.
CONTRAST = (
    "A lecturer told the meeting that early browsers had no scripts at all, and that pages opened looked plain without them.",
    "Our computing column answers: yes, you may switch JavaScript off at home, though some shops will then not load.",
    "The alderman asked why page 404 of the rate book was not found, and the clerk admitted an error of 224 pounds.",
    "The witness wrote XXXX in the witness book, being unable to sign, and the bench let it stand.",
    "Lots (1) to (18) fetched $14 each; see notice (overleaf), says the auctioneer.",
    "[The name of our correspondent is withheld at his wish. - Ed.]",
    "Readers should insert a coupon here at the counter of the office.",
    "The printer set lorem ipsum in a specimen, which the society admired.",
    "The schoolboy remembered no more of it than dolor and magna.",
    "The compositor explained that dummy text fills a page until the copy comes.",
    "The service to the town is temporarily unavailable to goods traffic, and a notice has been posted.",
    "The lost umbrella could not be found, and the councillor thanked the club.",
    "The loss of a fall in subscriptions and objections from ratepayers must come first.",
    "The server of the inn was not found at her post and access to the cellar was denied.",
    "[see overleaf]  [to be continued]  [signed] The Secretary.  (Concluded on page 6.)",
    "The doors bore the words <Ladies> and <Gentlemen> in gilt.",
    "Enter your dogs for the show by Friday; insert the peg firmly, says the maker of the tent.",
    "Insert the coin slowly, the lock-keeper told the visitors, and enter by the left gate.",
    "Shares closed: railway 101%, water 97%, dock 45%. Tea 2s. 4d.; candles 5d.; 3/6 the dozen.",
    "Seat No. 500 was empty, and ticket 403 was forbidden to no one.",
    "The gateway was in bad repair, the service of the chapel short, and the request of the choir refused.",
    "The constable's access to the yard was denied by a dog, and the connection with the coach was lost.",
    "He who tries again later may find the page torn from the register.",
    "An error in our last is regretted; the reader may turn to the notice on the back page.",
    "The script of the play was requested by the manager, and the server at the altar was late.",
    "An exception was taken to the fatal step, and the runner was out of breath and time.",
    "The prize sample of wheat was placed beside the dummy in the window; a test of the pump followed.",
    "Temporary lamps were required, and the room could not be used until they came.",
)

KINDS = ("template", "filler", "notice")
#: The sample's size and the share of its letters that are misread; bounds of the labelled sample.
TEMPLATES, FILLERS, NOTICES, COPIES, MISREAD = 9_000, 600, 1_500, 12, (0.0, 0.01, 0.04)


def _misread(text: str, share: float, rng: np.random.Generator) -> str:
    if not share:
        return text
    out = []
    for c in text:
        options = _OTHERS.get(c)
        out.append(options[rng.integers(len(options))] if options and rng.random() < share else c)
    return "".join(out)


_OTHERS = {one: rest.split() for line in MISREADINGS for one, _, rest in [line.partition(":")]}


def examples(seed: int = 7) -> dict[str, list[str]]:
    """The training sample of each kind: a few thousand short texts, the same at every call."""
    rng = np.random.default_rng(seed)

    def noisy(text: str) -> str:
        return _misread(text, MISREAD[rng.integers(len(MISREAD))], rng)

    templates = []
    for i in range(TEMPLATES):
        field = FIELDS[rng.integers(len(FIELDS))]
        if rng.random() < 0.3:  # a field of something
            field = f"{field}{'._ '[rng.integers(3)]}{FIELDS[rng.integers(len(FIELDS))]}"
        style = rng.integers(4)
        field = field.upper() if style == 0 else field.title() if style == 1 else field
        if rng.random() < 0.5:
            field = field.replace(" ", "_")
        templates.append(noisy(FORMS[i % len(FORMS)].replace("~", field)))
    fillers = [noisy(" ".join(rng.choice(LATIN, 30)).capitalize() + ".") for _ in range(FILLERS)]
    fillers += [noisy(t) for t in FILLER for _ in range(3 * COPIES)]
    for _ in range(FILLERS):
        parts = [rng.choice(x) for x in (SAMPLE_STARTS, SAMPLE_KINDS, SAMPLE_NOUNS, SAMPLE_ENDS)]
        fillers.append(noisy(" ".join(x for x in parts if x) + "."))
    fillers += [noisy(" ".join(rng.choice(KEYS, 14))) for _ in range(FILLERS // 4)]

    def one(options: tuple[str, ...]) -> str:
        return options[rng.integers(len(options))]

    def notice(text: str) -> str:
        digits = str(rng.integers(1, 1000))
        return noisy(text.replace("@", one(THINGS)).replace(" 0", " " + digits))

    notices = [notice(f"{one(STARTS)} {one(FAILS)} {one(DEEDS)}{one(CAUSES)} {one(ADVICE)}") for _ in range(NOTICES)]
    notices += [notice(f"{one(ENGINES)} {one(NEEDS)} {one(ENDS)} {one(THEN)}") for _ in range(NOTICES)]
    for _ in range(NOTICES):
        notices.append(notice(one(STATUS_FORMS).replace("~", one(STATUSES))))
        notices.append(notice(f"{one(PROGRAMS)}: {one(MISHAPS)} {one(WHERES)}"))
        notices.append(notice(f"{one(ASKS)} {one(SCRIPT_NAMES)} {one(PURPOSES)}."))
        notices.append(notice(f"{one(PLACES)} {one(RELIES)} {one(SCRIPT_NAMES)}."))
    notices += [notice(t) for t in BROWSER for _ in range(4 * COPIES)]
    notices += [notice(t) for t in STATES for _ in range(4 * COPIES)]
    for text in ERRORS + SCRIPTS:
        notices += [notice(text) for _ in range(2 * COPIES)]
    return {"template": templates, "filler": fillers, "notice": notices}
