"""Pages of layouts that no generator made, with the lines of their main text."""

LAYOUTS = {
    "blog": (
        """<body class="home blog"><div id="wrap"><div id="hd"><a href="/">My blog</a><p class="tagline">Notes of a walker</p></div><div id="topnav"><ul><li><a href="/a">Archive</a></li><li><a href="/b">About me</a></li></ul></div>
<div id="bd"><div class="hentry post-112"><h2>Over the pass in autumn</h2><p>We set out at six, when the valley was still in the shade, and followed the stream up to the first hut.</p><p>The path is steep there. It has been mended since last year, though, and nobody needs a rope.</p></div>
<div class="rail-right"><h4>Recent posts</h4><ul><li><a href="/1">A hut by the lake</a></li><li><a href="/2">Packing light</a></li></ul></div></div><div id="ft">Powered by nothing. Copyright 2019</div></div></body>""",
        ["Over the pass in autumn", "We set out at six, when the valley was still in the shade, and followed the stream up to the first hut.", "The path is steep there. It has been mended since last year, though, and nobody needs a rope."],
    ),
    "news": (
        """<body><div class="cookiebar">We use cookies. <a href="/p">More</a> <button>OK</button></div><div class="masthead-wrap"><a href="/"><img src="l.png" alt=""></a><div class="navlinks"><a href="/w">World</a> <a href="/s">Sport</a> <a href="/c">Culture</a></div></div>
<div class="story-body"><h1>Bridge reopens after two years</h1><p>The old bridge over the river was opened to traffic again on Monday, two years after the flood.</p><div class="ad-slot">Advertisement</div><p>The council said that the work had cost less than planned. Cyclists get a lane of their own.</p><p>Buses will use it from next week.</p></div>
<div class="morestories"><h3>More stories</h3><a href="/1">Market moves to the square</a> <a href="/2">School wins a prize</a></div><div class="pagefoot"><a href="/t">Terms</a> <a href="/c">Contact</a></div></body>""",
        ["Bridge reopens after two years", "The old bridge over the river was opened to traffic again on Monday, two years after the flood.", "The council said that the work had cost less than planned. Cyclists get a lane of their own.", "Buses will use it from next week."],
    ),
    "docs": (
        """<body><header class="topbar"><a href="/">Docs</a><form><input name="q"></form></header><div class="layout"><aside class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></aside>
<main><h1>Installing the tool</h1><p>Unpack the archive and put the folder on your path.</p><pre>tar xf tool.tar.gz</pre><h2>Options</h2><table><tr><th>Name</th><th>Meaning</th></tr><tr><td data-label="Name">quiet</td><td data-label="Meaning">Says nothing</td></tr></table></main></div><footer><p>Last edited in May.</p></footer></body>""",
        ["Installing the tool", "Unpack the archive and put the folder on your path.", "tar xf tool.tar.gz", "Options", "Name", "Meaning", "quiet", "Says nothing"],
    ),
    "recipe": (
        """<div class="container-fluid"><nav class="navbar"><a class="brand" href="/">Kitchen</a><ul><li><a href="/s">Soups</a><li><a href="/c">Cakes</a></ul></nav><div class="row"><div class="col-8 recipe"><h1>Leek soup</h1><p>This soup keeps for three days and can be frozen. It serves four.<ul><li>three leeks<li>one potato<li>a litre of stock</ul><p>Fry the leeks slowly, add the rest, and boil for twenty minutes.</div><div class="col-4 sidebar-widgets"><div class="newsletter-box">Get our letter every week!<form><input><button>Join</button></form></div></div></div><div class="reader-comments" id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely, I made it twice.</p></div><div class="comment"><p>Too salty for me.</p></div></div></div>""",
        ["Leek soup", "This soup keeps for three days and can be frozen. It serves four.", "three leeks", "one potato", "a litre of stock", "Fry the leeks slowly, add the rest, and boil for twenty minutes."],
    ),
    "unnamed": (
        """<html><body><div><a href="/">Start</a> | <a href="/map">Map</a> | <a href="/mail">Mail</a></div><div><p>The mill stands where two streams meet, and was built of stone from the quarry behind it.</p><p>It ground corn until the war. After that it was a store, then nothing, and since last year it has been a museum.</p><p>Visits are free on Sundays.</p></div><div>&copy; 2011 <a href="/i">Imprint</a></div></body></html>""",
        ["The mill stands where two streams meet, and was built of stone from the quarry behind it.", "It ground corn until the war. After that it was a store, then nothing, and since last year it has been a museum.", "Visits are free on Sundays."],
    ),
    "table": (
        """<body bgcolor=white><table width=100%><tr><td colspan=2><font size=5>The Village Page</font> <a href=/>home</a> <a href=/links.html>links</a></td></tr><tr><td width=120><a href=/1.html>History</a><br><a href=/2.html>Church</a><br><a href=/3.html>School</a></td><td class="maintext"><p>The village lies on the south side of the hill and has about four hundred people.</p><p>Its church is older than its name. The tower was added later, after the great fire.</p></td></tr></table></body>""",
        ["The village lies on the south side of the hill and has about four hundred people.", "Its church is older than its name. The tower was added later, after the great fire."],
    ),
    "forum": (
        """<body><div id="page-header"><h3><a href="/">Garden board</a></h3><ul class="linklist"><li><a href="/r">Register</a></li><li><a href="/l">Log in</a></li></ul></div><article class="topic"><h1>How to prune roses</h1><p>Cut in March, just above an eye that looks outwards, and never in frost.</p><p>Old wood goes first. What is left gets air and light, and flowers the better for it.</p></article><div class="signin-prompt">Log in to answer</div><div id="page-footer">All times are UTC</div></body>""",
        ["How to prune roses", "Cut in March, just above an eye that looks outwards, and never in frost.", "Old wood goes first. What is left gets air and light, and flowers the better for it."],
    ),
    "shop": (
        """<body><div class="promo-strip">Free delivery this week only!</div><div class="menu-top"><a href="/a">Chairs</a><a href="/b">Tables</a></div><section class="product-story"><h1>The bench by the door</h1><p>Oak, oiled twice, and made by two people in a shop that you can visit.</p><p>It carries three. We have sold it since 1987, and mend it for nothing.</p></section><section class="related-items"><h2>You may also like</h2><ul><li><a href="/c">A stool</a></li><li><a href="/d">A shelf</a></li></ul></section><div class="gdpr-consent">This shop stores cookies.</div></body>""",
        ["The bench by the door", "Oak, oiled twice, and made by two people in a shop that you can visit.", "It carries three. We have sold it since 1987, and mend it for nothing."],
    ),
}


def f1(got: str, want: list[str]) -> float:
    """Of the words, in any order."""
    from collections import Counter

    a, b = Counter(got.split()), Counter(" ".join(want).split())
    both = (a & b).total()
    return 2 * both / max(a.total() + b.total(), 1)
