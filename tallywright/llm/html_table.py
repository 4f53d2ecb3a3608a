"""The labelled table: short pages whose main text stands between main and rest."""

_LONG = "Rain fell on the hills for most of the week, and the river rose until it reached the old bridge."
_MORE = "People who live near the water carried sand to the wall, while others moved their animals to higher ground."
_THIRD = "By Friday the level had fallen again, and the town began to count what it had lost and what it had kept."

PAGES = [
    # An article between a menu, an advert and a footer.
    "<html><head><title>Rain</title></head><body><!--rest--><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li>"
    "<li><a href='/c'>Sports and more</a></li></ul></nav><div class='ad'>Buy a boat today and pay next year.</div>"
    f"<article><!--main--><h1>Rain in the hills</h1><p>{_LONG}</p><p>So it went.</p><p>{_MORE}</p><p>Short.</p><p>Yes.</p></article>"
    "<!--rest--><footer>&copy; The valley paper &middot; All rights reserved.</footer></body></html>",
    # Unclosed elements.
    f"<body><!--rest--><nav><a href='/'>Start</a> <a href='/x'>List</a></nav><div class='ad'>Two for one.<br>Now.</div><article><!--main--><h1>Water</h1><p><b>Water.<br><p>{_THIRD}</p>"
    f"<p>{_LONG}</p><p><b>End.<br></article><!--rest--><footer>Old town, 1999</footer>",
    # A sidebar, comments and a form around an article in a plain container.
    f"<body><!--rest--><header><a href='/'>Site</a><p>The best of sites</p></header><div id='content'><!--main--><h2>A wall</h2><p>{_MORE}</p><p>{_THIRD} <a href='/w'>Walls</a></p></div>"
    "<!--rest--><aside><h3>Most read</h3><ul><li><a href='/1'>One thing you should know about boats</a></li><li><a href='/2'>Another thing</a></li></ul></aside>"
    "<div class='comments'><h3>Comments</h3><p>Great piece, I was there when the bridge went under and it was frightening to see.</p><p>Me too.</p></div>"
    "<form><p>Write to us about what you saw, we read all of it.</p><label>Name</label></form><footer><p>Imprint</p></footer></body>",
    # Comments, sharing and related links inside the article.
    f"<body><!--rest--><div class='cookie-notice'><p>We use cookies to make this site work and to count visits. You may refuse.</p></div><main><article><header><!--main--><h1>Sand</h1></header><p>{_LONG}</p>"
    f"<!--rest--><div class='share'>Share this on every network</div><!--main--><p>{_MORE}</p><ul><li>sand</li><li>stone and clay</li></ul><blockquote>It held.</blockquote>"
    "<!--rest--><section class='related'><h4>Read next</h4><p><a href='/3'>The bridge of stone</a></p></section><section id='comments'><p>Thank you for writing this, it helped me a lot.</p><p>Nice</p></section></article></main>"
    "<footer><p>About us</p><p>We are a small paper of the valley and have been for many years.</p></footer></body>",
    # No containers at all: words and links decide.
    f"<body><!--rest--><p><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/k'>Contact</a></p><!--main--><p>{_LONG} {_MORE}</p><p>{_THIRD}</p><p>{_MORE} {_LONG}</p>"
    "<!--rest--><p><a href='/p'>Previous</a></p><p>Imprint <a href='/i'>here</a></p></body>",
    f"<body><!--rest--><div><a href='/'>Home</a></div><div><a href='/q'>Questions</a></div><!--main--><div>{_THIRD} {_LONG}</div><div>{_MORE}</div><!--rest--><div><a href='/t'>Terms of use</a></div><div>2001</div></body>",
    f"<body><!--rest--><table><tr><td><a href='/'>Home</a></td><td><a href='/u'>Up</a></td></tr></table><!--main--><p>{_MORE} {_THIRD}</p><p>{_LONG}</p><!--rest--><div><a href='/z'>Back to the top</a></div></body>",
    # Main element without an article; lists and tables in it.
    f"<body><!--rest--><header><h1>The valley paper</h1><p>News since 1901 from all over the valley</p></header><main><!--main--><h1>Levels</h1><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3 m</td></tr></table>"
    f"<p>{_THIRD}</p><ol><li>Count.</li><li>Repair.</li></ol></main><!--rest--><nav><p>More pages of this site</p></nav><footer>Contact us by post or by telephone at any time of the day.</footer></body>",
    # An advert and a newsletter inside the article.
    f"<body><article><!--main--><h1>Bridge</h1><p>Old.</p><p>{_LONG}</p><!--rest--><div class='advert'>Boots that keep you dry, now at half the price in our shop in the main street.</div><!--main--><p>{_MORE}</p>"
    f"<!--rest--><div class='newsletter-signup'><p>Get our letter every morning, it costs nothing and you can leave at any time.</p></div><!--main--><p>It stood.</p><p><a href='/m'>A map of the bridge</a> shows it.</p></article><!--rest--><div class='sidebar'><p>Weather: rain, and after that some more rain until the weekend.</p></div></body>",
    # A page of links without main text.
    "<body><!--rest--><ul><li><a href='/1'>First</a></li><li><a href='/2'>Second page</a></li><li><a href='/3'>Third</a></li></ul><p>Choose.</p></body>",
    "<body><!--rest--><div><a href='/1'>First</a></div><div><a href='/2'>Second</a></div><div>Site</div></body>",
    # Linked paragraphs in an article.
    f"<body><!--rest--><nav>Menu</nav><article><!--main--><h1><a href='/self'>Walls and water</a></h1><p><a href='/r'>Read the whole report.</a></p><p>{_THIRD}</p><p>And?</p><p><a href='/s'>Sources</a></p></article><!--rest--><aside class='promo'>Our shop has boots, coats and hats.</aside></body>",
    f"<body><!--rest--><div class='menu'>All pages</div><div class='post'><!--main--><h1>Clay</h1><p>Wet.</p><p>{_MORE}</p><p>Dry.</p></div><!--rest--><div class='footer'>The paper of the valley, printed weekly since 1901 in the old town.</div></body>",
    f"<body><!--rest--><div class='menu'>All</div><div class='entry-content'><!--main--><h2>Stone</h2><p>Hard.</p><p>{_LONG}</p></div><!--rest--><div class='legal'>Printed weekly.</div></body>",
    # Nothing behind the article, or nothing but it.
    f"<body><!--rest--><nav><a href='/'>Home</a></nav><article><!--main--><h1>Stone</h1><p>{_LONG}</p><p>Done.</p></article></body>",
    f"<body><article><!--main--><h1>Ford</h1><p>{_MORE}</p><p>It rained.</p><p>{_THIRD}</p><p>Then no more.</p></article>",
    f"<body><main><!--main--><h2>Wells</h2><p>{_THIRD}</p><ul><li>One.</li><li>Two of them.</li></ul></main>",
    f"<body><!--rest--><p><a href='/'>Home</a></p><!--main--><p>{_LONG} {_THIRD}</p><p>{_MORE}</p>",
    f"<!--main--><p>{_MORE}</p><p>{_LONG} {_MORE}</p>",
    f"<body><!--rest--><div>Site</div><!--main--><div>{_MORE} {_LONG}</div><div>{_THIRD}</div>",
    # Wrappers with telling names.
    f"<body><div class='site has-sidebar'><!--rest--><div class='menu'>All</div><article><!--main--><h1>Reeds</h1><p>{_LONG}</p><p>Tall.</p></article></div>",
    f"<form><!--rest--><div><a href='/'>Home</a></div><article><!--main--><div class='entry-header'><h1>Ice</h1></div><p>{_MORE}</p></article><!--rest--><footer>Since 1901.</footer></form>",
    # Short lines without containers: between long blocks, beside links and alone.
    f"<body><!--rest--><div>Top</div><!--main--><p>{_LONG} {_MORE}</p><p>So it went.</p><p>{_THIRD} {_LONG}</p><p>Not yet.</p><p>{_MORE} {_THIRD}</p><!--rest--><div>2004</div>",
    f"<!--rest--><p>Site</p><p>Since 1901</p><!--main--><p>{_THIRD} {_MORE}</p><p>Slowly.</p><p>{_LONG} {_THIRD}</p><!--rest--><p>Imprint</p><p>Terms</p>",
    f"<!--main--><p>{_MORE} {_LONG}</p><p>It held.</p><p>{_THIRD} {_LONG}</p><!--rest--><p>Sign in</p>",
    f"<body><!--rest--><div>Menu</div><div><a href='/1'>One</a></div><!--main--><p>{_LONG}</p><p>{_THIRD} {_MORE}</p><!--rest--><div>1999</div><div><a href='/e'>End</a></div>",
    "<body><!--rest--><div>Site</div><div>Sign in</div><div>All rights reserved</div></body>",
]
