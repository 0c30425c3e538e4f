"""Main text of hand-written pages in layouts of their own, and hostile pages in linear time."""

import time

import pytest

from shiori.llm import html_crf

#: Pages written by hand, each with the lines of its article.
PAGES = {
    "news": (
        """<!doctype html><html lang=en><head><title>Bridge reopens - Daily Courier</title><script>if (a<b) document.write("<p>x</p>")</script></head>
        <body class="has-sidebar single-post"><div id="masthead"><a href="/">Daily Courier</a><div class="tagline">All the news, every day</div></div>
        <nav class="primary"><ul><li><a href="/w">World</a><li><a href="/b">Business</a><li><a href="/s">Sport</a></ul></nav>
        <main><article><header><h1>Bridge reopens after two years of repair</h1><p class="byline">By Ana Kovac, 3 May 2021</p></header>
        <p>The old bridge over the river was opened to traffic on Monday, two years after the flood.</p>
        <div class="share-bar"><a href="#">Post</a> <a href="#">Mail</a></div>
        <p>Engineers replaced the main cables &amp; the deck. The work cost &euro;4 million, more than planned.</p>
        <figure><img src="b.jpg"><figcaption>The bridge on the day of its opening. Photo &copy; J. Horvat</figcaption></figure>
        <h2>What comes next</h2><p>A second lane is planned for the autumn.</p></article></main>
        <aside><h3>Most read</h3><ul><li><a href="/1">Storm warning for the coast</a><li><a href="/2">Five recipes for spring</a></ul></aside>
        <footer><p>&copy; 2021 Daily Courier Ltd. All rights reserved.</p><ul><li><a href="/t">Terms</a><li><a href="/p">Privacy</a></ul></footer></body></html>""",
        ["Bridge reopens after two years of repair", "By Ana Kovac, 3 May 2021", "The old bridge over the river was opened to traffic on Monday, two years after the flood.",
         "Engineers replaced the main cables & the deck. The work cost €4 million, more than planned.", "The bridge on the day of its opening. Photo © J. Horvat", "What comes next", "A second lane is planned for the autumn."],
    ),
    "blog": (
        """<html><head><title>On slow tea</title></head><body><div id="wrapper"><div id="header"><h2><a href="/">Kettle notes</a></h2></div>
        <div class="post hentry"><h1 class="entry-title">On slow tea</h1><div class="entry-content">
        <p>Most of us pour the water while it is still boiling. I used to do that as well.</p>
        <p>Wait. Count to ninety, and the leaves will thank you for it.</p>
        <blockquote><p>Patience is the first ingredient, said my grandmother.</p></blockquote>
        <ul><li>Warm the pot first.</li><li>Use two spoons for four cups.</li></ul>
        <p>That is all there is to it, really.</p></div></div>
        <div id="comments"><h3>3 comments</h3><ol class="commentlist"><li><p>I tried this yesterday and it works very well, thank you so much for writing it up.</p></li><li><p>Nonsense!</p></li></ol>
        <div id="respond"><form><p>Leave a reply</p><textarea></textarea></form></div></div>
        <div id="sidebar"><h3>About me</h3><p>I write about tea and rain.</p><h3>Archive</h3><ul><li><a href="/05">May</a></li><li><a href="/04">April</a></li></ul></div>
        <div id="footer">Powered by a small program</div></div></body></html>""",
        ["On slow tea", "Most of us pour the water while it is still boiling. I used to do that as well.", "Wait. Count to ninety, and the leaves will thank you for it.",
         "Patience is the first ingredient, said my grandmother.", "Warm the pot first.", "Use two spoons for four cups.", "That is all there is to it, really."],
    ),
    "manual": (
        """<html><body><nav class="toc"><a href="#1">Install</a><a href="#2">Run</a></nav><main id="main-content"><h1>Getting started</h1>
        <p>This page shows how to install the tool and run it for the first time.</p><h2 id="1">Install</h2>
        <pre><code>make all
        make install</code></pre><p>The second command needs the rights of an administrator.</p><h2 id="2">Run</h2>
        <table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>print more while the program runs</td></tr></table>
        <p>See the list of options above for what else it can do.</p></main>
        <div class="pager"><a href="/prev">Previous</a> <a href="/next">Next</a></div><footer>Copyright 2019 the authors</footer></body></html>""",
        ["Getting started", "This page shows how to install the tool and run it for the first time.", "Install", "make all make install", "The second command needs the rights of an administrator.", "Run",
         "Option", "Meaning", "-v", "print more while the program runs", "See the list of options above for what else it can do."],
    ),
    "tables": (
        """<html><body bgcolor=white><table width=100%><tr><td class="menu"><a href=a>Home</a><br><a href=b>Products</a><br><a href=c>Contact</a>
        <td><h1>The history of our mill</h1><p>The mill was built in 1874 by two brothers who came from the north.
        <p>It burned down twice and was rebuilt each time, larger than before.<p>Today it grinds flour for the bakeries of the valley.</table>
        <p align=center><font size=1>&copy; 1999 Mill &amp; Sons</font></body></html>""",
        ["The history of our mill", "The mill was built in 1874 by two brothers who came from the north.", "It burned down twice and was rebuilt each time, larger than before.", "Today it grinds flour for the bakeries of the valley."],
    ),
    "divs": (
        """<html><body><div class="k3"><div class="cookie-banner"><div>We use cookies to make this site better for you. <a href="/c">Settings</a></div></div>
        <div class="z9"><h1>Why cats purr</h1><div class="q1">Cats purr when they are content, but also when they are hurt or afraid of something.</div>
        <div class="q1">The sound is made by muscles in the throat that move about thirty times a second.</div>
        <div class="ad-slot">Buy our cat food now!</div>
        <div class="q1">Some people think that the trembling helps bones to heal, though nobody has shown it yet.</div></div>
        <div class="newsletter-signup">Get our letter every week. <form><input><button>Join</button></form></div></div></body></html>""",
        ["Why cats purr", "Cats purr when they are content, but also when they are hurt or afraid of something.", "The sound is made by muscles in the throat that move about thirty times a second.",
         "Some people think that the trembling helps bones to heal, though nobody has shown it yet."],
    ),
    "wiki": (
        """<html><body><div id="content"><h1 id="firstHeading">Salt marsh</h1><div id="bodyContent"><p>A <b>salt marsh</b> is a <a href="/w">coastal</a> <a href="/e">ecosystem</a> between land and open salt water that is flooded by the tides.</p>
        <h2>Plants</h2><p>Few plants can live in salt; <a href="/s">cordgrass</a> and <a href="/g">glasswort</a> are the best known of them.</p><ul><li>Cordgrass, near the water</li><li>Sea lavender, higher up</li></ul>
        <p>The mud holds much carbon &copy and many worms.</p></div></div>
        <div id="mw-navigation"><div class="menu"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random article</a></li></ul></div></div>
        <div id="footer"><ul><li>This page was last edited on 2 June 2020.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>""",
        ["Salt marsh", "A salt marsh is a coastal ecosystem between land and open salt water that is flooded by the tides.", "Plants", "Few plants can live in salt; cordgrass and glasswort are the best known of them.",
         "Cordgrass, near the water", "Sea lavender, higher up", "The mud holds much carbon © and many worms."],
    ),
    "recipe": (
        """<html><body><header class="site-header"><a href="/">Good Food</a></header><article class="recipe"><h1>Leek soup</h1><p>Serves four, takes half an hour.</p>
        <aside class="promo"><p>Our new cookbook is out now, order it today!</p></aside>
        <h2>You need</h2><ul><li>3 leeks<li>1 l water<li>salt</ul><h2>Do this</h2><ol><li>Cut the leeks into rings and wash them well.<li>Boil them for twenty minutes.</ol><p>Eat it hot, with bread.</p>
        <section class="comments"><h2>What readers say</h2><div class="comment"><p>Lovely soup, my children asked for more of it.</p></div></section></article>
        <footer class="site-footer">&copy; Good Food</footer></body></html>""",
        ["Leek soup", "Serves four, takes half an hour.", "You need", "3 leeks", "1 l water", "salt", "Do this", "Cut the leeks into rings and wash them well.", "Boil them for twenty minutes.", "Eat it hot, with bread."],
    ),
    "bare": (
        """<title>Letter</title><h1>A letter from the island</h1>Dear all, the boat came late again this week, and the post with it.<br><br>We have had nothing but wind since Tuesday.
        <p>The hens are well. The roof is not.<p>Write soon!<p>&copy; The island post""",
        ["A letter from the island", "Dear all, the boat came late again this week, and the post with it. We have had nothing but wind since Tuesday.", "The hens are well. The roof is not.", "Write soon!"],
    ),
    "section": (
        """<html><body><div id="page"><div class="top-nav"><ul><li><a href="/a">Start</a></li><li><a href="/b">Topics</a></li></ul></div>
        <section class="story"><header><h1>Night trains are back</h1><div class="meta">Travel desk</div></header><p>After ten years without them, night trains run again from the capital to the sea.</p>
        <p>Tickets start at 29 a head; a bed costs twice that.</p><p>"I slept like a stone," said one passenger.</p></section>
        <section class="related-stories"><h2>Read also</h2><ul><li><a href="/x">Buses that swim</a></li><li><a href="/y">A tram for every street</a></li></ul></section>
        <div class="login-box"><form>Sign in to read more <input></form></div></div></body></html>""",
        ["Night trains are back", "Travel desk", "After ten years without them, night trains run again from the capital to the sea.", "Tickets start at 29 a head; a bed costs twice that.", "\"I slept like a stone,\" said one passenger."],
    ),
    "japanese": (
        """<html lang=ja><body><header><nav><ul><li><a href="/">ホーム</a></li><li><a href="/n">ニュース</a></li></ul></nav></header><div class="main"><div class="entry"><h1>春の庭</h1>
        <p>庭の桜が咲いた。朝から鳥が鳴いている。</p><p>夕方には雨が降り、花びらが道を白くした。</p></div></div><div class="sidebar"><ul><li><a href="/1">夏の海</a></li><li><a href="/2">秋の山</a></li></ul></div>
        <footer>© 春日和</footer></body></html>""",
        ["春の庭", "庭の桜が咲いた。朝から鳥が鳴いている。", "夕方には雨が降り、花びらが道を白くした。"],
    ),
}


PAGES |= {
    "columns": (
        """<html><body><div id=wrap><div id=col1><h2>Post heading here</h2><div>The first thing that I want to tell you is that the garden is full of snails this year.</div>
        <div>They came with the rain in May, and nobody knows how to make them leave again.</div></div>
        <div id=col2><h4>Archive</h4><ul><li><a href="/5">May 2020</a></li><li><a href="/4">April 2020</a></li><li><a href="/3">March 2020</a></li></ul></div></div></body></html>""",
        ["Post heading here", "The first thing that I want to tell you is that the garden is full of snails this year.", "They came with the rain in May, and nobody knows how to make them leave again."],
    ),
    "books": (
        """<html><body><nav><a href="/">Home</a></nav><article><h1>Books to read in winter</h1><p>These are the books that we liked best this year, in no order.</p>
        <ul><li><a href="/1">The first book of many</a></li><li><a href="/2">A house by the sea</a></li><li><a href="/3">Snow</a></li></ul><p>Tell us what you have read, and we will add it to the list.</p></article></body></html>""",
        ["Books to read in winter", "These are the books that we liked best this year, in no order.", "The first book of many", "A house by the sea", "Snow", "Tell us what you have read, and we will add it to the list."],
    ),
    "links": (
        """<html><body><header><a href="/">The pond</a></header><main><h1>Talks of the meeting</h1><p>All talks were recorded and can be seen here.</p><ul><li><a href="/1">How frogs sleep</a><li><a href="/2">Water and iron</a><li><a href="/3">What the heron saw</a></ul>
        <p>The next meeting is in June.</p></main><footer>&copy; The pond society</footer></body></html>""",
        ["Talks of the meeting", "All talks were recorded and can be seen here.", "How frogs sleep", "Water and iron", "What the heron saw", "The next meeting is in June."],
    ),
    "left column": (
        """<html><body><div class="outer"><div class="left"><p>Topics</p><ul><li><a href="/a">Stones</a><li><a href="/b">Metals</a><li><a href="/c">Glass</a></ul></div>
        <div class="right"><h1>How glass is cut</h1><p>A wheel of hard steel makes a fine line on the glass, and the glass then breaks along it.</p><p>The line must be drawn once only.</p></div></div><p>&copy; 2011 The workshop</p></body></html>""",
        ["How glass is cut", "A wheel of hard steel makes a fine line on the glass, and the glass then breaks along it.", "The line must be drawn once only."],
    ),
    "forum": (
        """<html><body><div id="top-bar"><a href="/l">Log in</a> <a href="/r">Register</a></div><div class="thread-title"><h1>My bike makes a noise</h1></div>
        <div class="post-body"><p>When I ride uphill there is a noise from the back wheel, like a small bell.</p><p>It stops when I stop pedalling. What can it be?</p></div>
        <div class="replies"><div class="reply"><p>Check the chain first, it may be dry.</p></div><div class="reply"><p>Mine did that too, it was the brake.</p></div></div><div class="footer-links"><a href="/h">Help</a></div></body></html>""",
        ["My bike makes a noise", "When I ride uphill there is a noise from the back wheel, like a small bell.", "It stops when I stop pedalling. What can it be?"],
    ),
    "press": (
        """<html><body><div class="cookie-consent"><p>This site uses cookies.</p><button>Fine</button></div><div role="main"><h1>Harbour to be widened</h1><p class="date">12 March 2018</p>
        <p>The council has voted to widen the harbour so that larger ships can enter it at low tide.</p><p>Work begins in the autumn and will take three years.</p><p>For questions, call the office of the harbour master.</p></div>
        <div class="social-share"><a href="#">Share</a></div><div class="related"><h3>More news</h3><a href="/1">Fish prices fall</a><a href="/2">New ferry</a></div></body></html>""",
        ["Harbour to be widened", "12 March 2018", "The council has voted to widen the harbour so that larger ships can enter it at low tide.", "Work begins in the autumn and will take three years.", "For questions, call the office of the harbour master."],
    ),
    "glossary": (
        """<html><body><nav class="breadcrumbs"><a href="/">Start</a> &gt; <a href="/g">Words</a></nav><article><h1>Words of the trade</h1><dl><dt>Adze<dd>A tool for shaping wood, like an axe with a turned blade.<dt>Bevel<dd>An edge that is not square.</dl></article>
        <aside class="advert"><p>Learn the trade in ten weeks!</p></aside></body></html>""",
        ["Words of the trade", "Adze", "A tool for shaping wood, like an axe with a turned blade.", "Bevel", "An edge that is not square."],
    ),
    "two boxes": (
        """<html><body><div id=x7><div id=k1><h2>Rain in the hills</h2><div>It has rained in the hills for nine days, and the streams are higher than they have been in years.</div><div>Sheep were moved to the barns on Tuesday.</div></div>
        <div id=k2><h4>Pages</h4><ul><li><a href="/a">About</a></li><li><a href="/m">Map</a></li></ul><h4>Friends</h4><ul><li><a href="/o">Other hills</a></li></ul></div></div></body></html>""",
        ["Rain in the hills", "It has rained in the hills for nine days, and the streams are higher than they have been in years.", "Sheep were moved to the barns on Tuesday."],
    ),
}


def test_hand_written_layouts():
    model, kept, found, wanted = html_crf.default_model(), 0, 0, 0
    report = []
    for name, (page, lines) in PAGES.items():
        got = html_crf.main_text(model, page).split("\n")
        assert got != [""], name
        both = sum(min(got.count(x), lines.count(x)) for x in set(lines))
        report += [(name, "+", x) for x in got if x not in lines] + [(name, "-", x) for x in lines if x not in got]
        kept, found, wanted = kept + both, found + len(got), wanted + len(lines)
    assert kept / wanted >= 0.97 and kept / found >= 0.97, report


@pytest.mark.parametrize("page,text", [
    ("<article><p>x &copy; 2020 text.</p><div class='share'>Share</div><p>y</p></article>", "x © 2020 text.\ny"),
    ("<div id=xyz><h1>Title</h1><div>Text in divs is text as well, and long enough.</div></div>", "Title\nText in divs is text as well, and long enough."),
    ("<title>Leak</title><article><p>Text that is here.</p></article>", "Text that is here."),
    ("<article><h1>A</h1><p>one <b>two</b> <br>three<p>four &lt;b&gt; &#228;</article>", "A\none two three\nfour <b> ä"),
    ("<article><p>a <a title='x > y'>b</a> c</p><p title=it's>d</p></article>", "a b c\nd"),
    ("<article><p>a<!-- <p>b --> c</p><p>d<svg><text>e</text></svg> f<button>g</article>", "a c\nd fg"),
])
def test_pages(page, text):
    assert html_crf.main_text(html_crf.default_model(), page) == text


HOSTILE = ["<a '", "<!", "<div>x", "<a =\"", "</i>", "<p class=a'>x", "<b><div>", "<script", "</script", "<button>x", "<li>x", "<table><tr><td>x", "<div class=ab>x</p>", "<h1>x</h2></div>", "<a b='>' ", "<p x='y", "<!--", "<textarea>"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_time_is_linear(unit):
    model = html_crf.default_model()

    def taken(size):
        page = unit * (size // len(unit))
        began = time.perf_counter()
        html_crf.main_text(model, page)
        return time.perf_counter() - began

    taken(1 << 12)
    small, large = taken(1 << 17), taken(1 << 19)
    assert large < 12 * small + 0.2 and large < 10, (small, large)


def test_deep_and_unmatched_nesting():
    model = html_crf.default_model()
    began = time.perf_counter()
    html_crf.main_text(model, "<div>" * 40_000 + "</ul>" * 40_000)
    html_crf.main_text(model, "".join(f"<div class=w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>x" for i in range(20_000)))
    html_crf.main_text(model, "<script>" + "</script" * 100_000)
    assert time.perf_counter() - began < 10
