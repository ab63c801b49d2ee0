"""Pages written by hand, each with the blocks of its article: none of them from the generator that the trees learn from."""


# fmt: off
L = ["The river rose in the night and by the morning it had reached the lower houses, whose people had gone up the hill with what they could carry.",
   "Nobody had seen the water so high since the year of the great flood, when the old bridge was lost and with it the road to the market.",
   "In the afternoon the rain stopped at last, and those who had stayed behind began to clear the mud from the doors of the church.",
   "The council met in the school, which stands on higher ground, and agreed to ask the county for boats, blankets and a second pump.",
   "By the end of the week the fields were dry again, though it would be months before anything could be sown in them."]


def P(*paragraphs):
    return "".join(f"<p>{t}</p>" for t in paragraphs)


NAV = '<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>'
FOOT = '<footer><p>Copyright 2024 The Valley Post. All rights reserved.</p><ul><li><a href=/t>Terms</a></li><li><a href=/p>Privacy</a></li></ul></footer>'
CASES = [
 (f"<html><body>{NAV}<article>{P(L[0],L[1])}<p>See <a href=/1>the first report</a> and <a href=/2>the second report</a>.</p>{P(L[2])}</article>{FOOT}</body></html>",[L[0],L[1],"See the first report and the second report.",L[2]]),
 (f"<html><body>{NAV}<div id=content>{P(L[0],L[1])}<p>See <a href=/1>the first report</a> and <a href=/2>the second report</a>.</p>{P(L[2])}</div>{FOOT}</body></html>",[L[0],L[1],"See the first report and the second report.",L[2]]),
 (f"<html><body>{NAV}<article>{P(L[0],L[1])}<h2>References</h2><ul><li><a href=/1>First report on bridges</a></li><li><a href=/2>Second report on roads</a></li><li><a href=/3>Minutes of the council</a></li></ul></article>{FOOT}</body></html>",[L[0],L[1],"References","First report on bridges","Second report on roads","Minutes of the council"]),
 (f'<html><body>{NAV}<article>{P(L[0])}<p>The <span class="header">quick</span> brown <b id="top">fox</b> ran <span class="notice">home</span>, as it did every night before the rain came.</p>{P(L[1])}</article>{FOOT}</body></html>',[L[0],"The quick brown fox ran home, as it did every night before the rain came.",L[1]]),
 (f"<html><body>{NAV}<article><h1>T</h1>{P(L[0],L[1])}</article>{FOOT}</body></html>",["T",L[0],L[1]]),
 (f'<html><body>{NAV}<article><header><h1>Flood</h1><p class="byline">By Ann</p></header>{P(L[0],L[1],L[2])}</article>{FOOT}</body></html>',["Flood","By Ann",L[0],L[1],L[2]]),
 (f"<html><body>{NAV}<article>{P(L[0],L[1])}<aside>Also read: ten tips for you</aside>{P(L[2])}</article>{FOOT}</body></html>",[L[0],L[1],L[2]]),
 (f'<html><body><div class="topbar"><a href=/>The Valley Post</a></div><main><h1>The flood of the year</h1>{P(*L)}</main><div class="sidebar"><h3>Popular</h3><ul><li><a href=/a>One thing</a></li><li><a href=/b>Another thing</a></li></ul></div>{FOOT}</body></html>',["The flood of the year",*L]),
 (f'<html><body>{NAV}<div class="post"><h2>Day two</h2>{P(L[0])}<div class="ad">Buy boots now, half price</div>{P(L[1])}<blockquote><p>We will be back, said the miller, before the leaves fall from the trees.</p></blockquote></div><section class="comments"><h3>Comments</h3><div class="comment"><p>I was there and it was worse than that, believe me.</p></div></section></body></html>',["Day two",L[0],L[1],"We will be back, said the miller, before the leaves fall from the trees."]),
 (f'<html><body><header><h1>Valley Post</h1>{NAV}</header><article><h1>Water</h1><p>Short lead.</p>{P(L[3],L[4])}<figure><img src=x><figcaption>The bridge on Monday.</figcaption></figure></article></body></html>',["Water","Short lead.",L[3],L[4],"The bridge on Monday."]),
 (f'<html><body>{NAV}<article><h1>Pumps</h1>{P(L[0])}<table><tr><th>Village</th><th>Pumps</th></tr><tr><td>Upton</td><td>three</td></tr></table>{P(L[1])}</article><div class="cookie-notice"><p>We use cookies to make this site better for you.</p><button>OK</button></div></body></html>',["Pumps",L[0],"Village","Pumps","Upton","three",L[1]]),
 (f'<html><body><form class="search"><label>Search</label><input><button>Go</button></form><section class="content"><h1>Notes</h1>{P(L[2])}<ol><li>Bring boots and a lamp.</li><li>Call <a href=/w>the warden</a> before you leave.</li></ol>{P(L[3])}</section>{FOOT}</body></html>',["Notes",L[2],"Bring boots and a lamp.","Call the warden before you leave.",L[3]]),
 (f'<html><body>{NAV}<main><article><h1>Letters</h1>{P(L[0],L[4])}<div class="share"><a href=/f>Share</a> <a href=/t>Tweet</a></div><div class="related"><h3>Related</h3><p>More on the flood of last year</p></div></article></main>{FOOT}</body></html>',["Letters",L[0],L[4]]),
 (f'<html><body><p>{L[0]}</p><p>{L[1]}</p></body></html>',[L[0],L[1]]),
 (f'<html><body>{NAV}<article><h1>Bridge</h1><p>{L[0]} <em class="x">Truly</em>, it was <code class="menu">so</code>.</p><pre>level 3.5\nlevel 4.1</pre></article></body></html>',["Bridge",L[0]+" Truly, it was so.","level 3.5 level 4.1"]),
 (f'<html><body>{NAV}<article><header><h1>Market day</h1></header>{P(L[1],L[2])}<p style="display:none">secret text that nobody sees</p><p><a href=/more>Read the whole of the council&#39;s answer here</a></p>{P(L[3])}</article>{FOOT}</body></html>',["Market day",L[1],L[2],"Read the whole of the council's answer here",L[3]]),
 (f'<html><body>{NAV}<div class="container"><div class="entry-content"><h1>Terms of rivers</h1><dl><dt>Ford</dt><dd>A place where a river may be crossed on foot.</dd><dt>Weir</dt><dd>A low wall that holds the water back.</dd></dl>{P(L[0])}</div><aside><h3>About</h3><p>The Valley Post has been written by volunteers since 1921.</p></aside></div>{FOOT}</body></html>',["Terms of rivers","Ford","A place where a river may be crossed on foot.","Weir","A low wall that holds the water back.",L[0]]),
 (f'<html><body><div id="nav"><a href=/>Home</a> | <a href=/b>Blog</a> | <a href=/c>Contact</a></div><div id="main"><h1>Mud</h1>{P(L[2],L[3],L[4])}</div><div id="footer">Copyright 2023, made by hand</div></body></html>',["Mud",L[2],L[3],L[4]]),
 (f'<html><body>{NAV}<article class="post"><h1>Boats</h1><time class="date">4 May</time>{P(L[0])}<h2>What is needed</h2><ul><li>blankets</li><li>lamps</li><li>rope</li></ul>{P(L[1])}</article><div class="newsletter"><p>Sign up for our letter</p><input><button>Send</button></div>{FOOT}</body></html>',["Boats","4 May",L[0],"What is needed","blankets","lamps","rope",L[1]]),
 (f'<html><body>{NAV}<article><h1>Sources</h1><p>This page draws on <a href=/1>the county survey</a>, <a href=/2>the parish books</a>, <a href=/3>a map of 1840</a> and <a href=/4>two letters</a>.</p>{P(L[0],L[3])}<p><small>Last changed in May.</small></p></article>{FOOT}</body></html>',["Sources","This page draws on the county survey, the parish books, a map of 1840 and two letters.",L[0],L[3],"Last changed in May."]),
]
