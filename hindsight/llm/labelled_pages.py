"""Small labelled pages from which the extraction weights are learned.

The content of each page lies between the marks ``[[`` and ``]]``; everything else is
boilerplate. The pages were written for this purpose.
"""

PAGES = (
    "<html><head><title>News</title></head><body><div class=top><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div>"
    "<article>[[<h1>River rises</h1><p>The river rose by two metres on Monday, and the town closed both bridges.</p><p>It fell again on Tuesday <b>without damage</b>.<br>Schools open.</p>]]</article>"
    "<div><a href=/1>One</a><a href=/2>Two</a><a href=/3>Three</a></div></body></html>",
    "<body><table><tr><td><a href=a>Index</a></td><td><a href=b>Map</a></td></tr></table><main>[[<h2>How to bake</h2><ol><li>Mix the flour with water and wait.</li><li>Bake it for an hour.</li></ol>"
    "<p>Let it cool; then <i>slice</i> it and serve it with <a href=x>butter</a>.</p>]]</main><div><span>Last change</span><span>by admin</span></div></body>",
    "<body><div><ul><li><a href=1>Start</a><li><a href=2>Blog</a><li><a href=3>Contact</a></ul></div><article>[[<h1>A quiet week</h1><p>Nothing much happened here this week, and I was glad of it."
    "<p>I read three books, <em>two of them</em> twice.<blockquote>To read is to travel.</blockquote><p>More next week.]]</article><div><a href=p>Previous</a> <a href=n>Next</a></div></body>",
    "<body><div>You are here: <a href=/>Home</a></div><article>[[<h1>Results</h1><p>The table shows the yearly means of all stations.</p><table><tr><th>Year<th>Mean<tr><td>1990<td>7.1<tr><td>1991<td>7.4</table>"
    "<h2>Method</h2><p>Stations with gaps of more than ten days were left out.</p><ul><li>Daily values were averaged.</li><li>Leap days count.</li></ul>]]</article><div><img src=a><img src=b></div></body>",
    "<body><span><a href=1>EN</a> | <a href=2>DE</a> | <a href=3>FR</a></span><main>[[<p>This note answers the question that most readers send: why does the clock run slow in winter?</p>"
    "<p>The pendulum is of brass. Brass shrinks in the cold, and a short pendulum runs <strong>fast</strong>, so the cause lies elsewhere.</p><pre>period = 2 pi sqrt(l / g)</pre><p>Look at the oil.</p>]]</main><div><a href=t>Top</a></div></body>",
    "<body><div><a href=/>Site</a></div><article>[[<div><h3>A walk</h3><p>We left the village at dawn and followed the stream.</p><figure><img src=x><figcaption>The mill</figcaption></figure></div>"
    "<div><span>By noon</span> we had reached the pass; a <code>map</code> helped.<hr><dl><dt>Height</dt><dd>1900 m</dd></dl><table><tbody><tr><td>Up</td><td>4 h</td></tr></tbody></table></div><section><h4>Return</h4><p>Bus.</p></section>]]</article><hr><a href=t>Top</a></body>",
)
