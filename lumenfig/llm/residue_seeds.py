"""Texts of known kind on which the residue models are fitted."""

from __future__ import annotations

#: Words of the customary blind text.
BLIND_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur"
).split()

#: Filler that stands where a text should be.
FILLER = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "placeholder", "placeholder placeholder", "placeholder placeholder placeholder", "Placeholder text.", "This is placeholder text.",
    "test", "test test", "test test test", "test test 123", "testing 123", "asdf", "asdf asdf", "asdf qwer", "qwer asdf qwer", "asdf jkl qwer zxcv", "qwerty",
    "xxx", "xxxx", "xxxxx", "xxxxx xxxxx", "xxx xxx xxx", "foo bar baz", "blah blah blah", "abc abc abc", "aaaa aaaa", "...", "n/a n/a",
    "Your text here", "Your description here", "Your title here.", "Your caption goes here.", "Dummy text", "Dummy text goes here.", "Example text goes here.", "This is some sample text.",
    "Insert text here.", "Insert description here.", "Insert a summary of the page here.", "Insert the title of the article here.", "Insert a one-sentence caption here.", "Insert one sentence about the image here.", "Write a short summary of the image at this point.", "Put a heading at this point.", "Add a description here.", "Add the body of your message here.", "Enter your text here.", "Type here.", "Write something here.",
    "Text to be added later.", "Details to follow.", "To be supplied.", "Text will be supplied later by the author.", "Image to be supplied by the editor.", "Further information will be provided later.", "To be completed.", "To be determined.", "To be announced.", "Coming soon.", "Content goes here.", "More text to follow.",
    "Blind text used in place of real text.", "Some blind text used to fill the page.", "Words used to fill a slot until the real ones are ready.", "Left open until the model answers.", "Filler text that shows how the final text will look.", "This space is left empty on purpose.", "No description yet.", "Replace this text with your own.",
]

_CODES = {
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 408: "Request Timeout", 410: "Gone", 413: "Payload Too Large",
    429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}

#: Messages of servers, gateways and programs, and notices that something must be switched on.
NOTICES = [
    *[f"{c} {m}" for c, m in _CODES.items()],
    *[f"Error {c}: {m.lower()}. Please try again later." for c, m in _CODES.items()],
    *[f"HTTP {c} {m}" for c, m in _CODES.items()],
    *[f"<html><head><title>{c} {m}</title></head></html>" for c, m in _CODES.items()],
    *[f'{{"error": "{m}", "status": {c}}}' for c, m in (*_CODES.items(), (503, "Service is starting"), (503, "overloaded"), (500, "timeout"))],
    "<html><body><h1>Error</h1></body></html>", "<center>nginx</center>", "<!DOCTYPE html>",
    "The resource you requested could not be found (HTTP 404).", "The requested URL was not found on this server.", "The requested page could not be found.", "The resource could not be loaded.",
    "The page you are looking for does not exist.", "Page not found.", "Page not available.", "Page not available. The page has been moved or deleted.", "Sorry, what you were looking for has been moved or removed.", "The item you requested is no longer available.",
    "Access denied.", "Access denied. You don't have permission to access this resource.", "Your session has expired.", "Your session has timed out, please log in again.", "Please sign in to continue.", "Please log in to view this page.",
    "Something went wrong. Please try again later.", "An error occurred while processing your request.", "An unexpected error occurred.", "Service temporarily unavailable.", "The service is temporarily unavailable, please retry.", "Rate limit exceeded.", "Too many requests, slow down.",
    "upstream request timeout", "upstream connect error or disconnect/reset before headers.", "The gateway timed out before an answer came; reference id 3c6a07de.", "Timed out while waiting for a response from the server.", "Connection timed out.", "Connection refused.", "Connection reset by peer.", "Read timed out.", "request id 7f3b91ac", "request id cb9f142e",
    "Traceback (most recent call last):", "Traceback (most recent call last): KeyError 'name'", "Traceback (most recent call last): ValueError", "KeyError: 'field'", "KeyError 'value'", "TypeError: 'NoneType' object is not subscriptable", "NullPointerException", "Exception in thread main", "RuntimeError: CUDA out of memory", "undefined is not a function", "[object Object]", "Segmentation fault",
    "Please enable JavaScript.", "Please enable JavaScript to continue.", "Please enable JavaScript to view the comments.", "Please switch JavaScript on and load the page again.", "JavaScript is disabled.", "It looks like JavaScript is disabled in this browser.", "JavaScript is required to view this page.", "You need to enable JavaScript to run this app.",
    "This page requires JavaScript.", "This page needs scripts to work; switch them on, then load it again.", "This page requires JavaScript; please turn it on and reload.", "Scripts are off: turn them on and reload the page.", "This site requires cookies and scripts to be enabled.", "Please make sure that your browser supports cookies and scripts and does not block them.", "Please allow cookies to continue.", "Your browser does not support JavaScript.", "Your browser has scripts turned off, so the page cannot be shown.", "For full functionality of this site it is necessary to enable scripts.", "This app does not work properly without JavaScript enabled.",
    "Your browser does not support the video tag.", "Your browser is out of date.", "<noscript>JavaScript must be active.</noscript>", "<noscript>You need to enable JavaScript to run this app.</noscript>", "Scripting has to be allowed for this site.",
    "Checking your browser before accessing the site.", "Please allow up to a few seconds.", "This process is automatic, your browser will redirect shortly.", "Just a moment...", "Verify that you are human.", "Please complete the security check to proceed.", "Enable JavaScript and cookies to continue.",
    "Habilite JavaScript para usar este sitio.", "Active las cookies y JavaScript de su navegador.", "Active JavaScript para continuar.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Veuillez activer JavaScript dans votre navigateur.",
]

#: Markers of work left undone, and how templating languages write a slot; ~ stands for its name.
#: A value that was never set, as programs print it, but not where a sentence says that something is undefined.
UNSET = r"\bundefined\b" + "".join(rf"(?<!\b{w} undefined)" for w in ("is", "are", "was", "be", "left", "remains", "an")) + r"(?! (?:behaviou?r|variables?|values?|references?|functions?|symbols?|terms?|steps?)\b)"
MARKERS = ["TODO", "TBD", "TBA", "FIXME", "XXX", "XXXX"]
SLOTS = [
    "{~}", "{{~}}", "{{ ~ }}", "${~}", "<~>", "<<~>>", "%~%", "@@~@@", "__~__", "[INSERT ~]", "[~ HERE]", "[YOUR ~]", "{% ~ %}", "[[~]]", "$~$", "##~##", "#~#",
    "%s", "%d", "{}", "{0}", "{1}", "____", "______", "(fill in)", "(to be filled in)", "#REF!", "#N/A", "#NAME?", "#VALUE!", "<%= ~ %>",
]
