"""The word lists and constants that results depend on."""

#: Stop words of the crawl analyser.
CRAWL_STOPWORDS = (
    "a about above after again against ain all am an and any are aren as at be because been before being below between both but by "
    "can couldn d did didn do does doesn doing don down during each few for from further had hadn has hasn have haven having he her "
    "here hers herself him himself his how i if in into is isn it its itself just ll m ma me mightn more most mustn my myself "
    "needn no nor not now o of off on once only or other our ours ourselves out over own re same shan she should shouldn so some "
    "such t than that the their theirs them themselves then there these they this those through to too under until up ve very was "
    "wasn we were weren what when where which while who whom why will with won wouldn y you your yours yourself yourselves"
).split()

#: Stop words of the index and query analyser.
INDEX_STOPWORDS = (
    "a an and are as at be been being but by for from had has have he her hers him his i if in into is it its me my of on or "
    "our ours she so that the their them then there these they this those to was we were what when where which who will with you your"
).split()

#: Stop words of the in-memory corpus's analyser.
SIMPLE_STOPWORDS = "a an and are as at be by for from has in is it its of on or that the to was were will with".split()

#: Irregular forms and their lemmas.
IRREGULAR = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "has": "have", "had": "have", "does": "do", "did": "do",
    "went": "go", "gone": "go", "better": "good", "best": "good", "children": "child", "men": "man", "women": "woman",
    "mice": "mouse", "geese": "goose", "teeth": "tooth", "feet": "foot", "ran": "run",
}

#: HTML elements whose boundaries break the flow of text, and those whose content isn't visible.
BLOCK_TAGS = (
    "address article aside blockquote br caption col colgroup dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
HIDDEN_TAGS = "script style noscript head template".split()

#: The mark between sections of a page's text.
SECTION_BREAK = "\x00"
#: What a query of stop words only is answered with, and how many documents.
STOPWORD_NOTICE = "This query only contains stopwords."
STOPWORD_DOCS = 10
#: Feedback: terms taken of a relevant document, terms added to a query, and how often at most each.
FEEDBACK_DOC_TERMS, FEEDBACK_MAX_TERMS, FEEDBACK_MAX_REPEAT = 25, 10, 2
#: BM25 parameters, MMR's trade-off and pool, Rocchio's weights.
BM25_K1, BM25_B = 1.5, 0.75
MMR_LAMBDA, MMR_POOL = 0.7, 20
ROCCHIO = (1.0, 0.75, 0.15)
#: HTTP statuses that are worth another try.
RETRIABLE = (429, 500, 502, 503, 504)
