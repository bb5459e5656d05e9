"""Fields, tables and sections of hand-made forms."""

from pyspark.sql import functions as F

from barloom.operators import forms

cell = lambda label, value, css="FormData": f'<tr><td class="x">{label}</td><td>between</td><td class="{css} wide"> {value} </td></tr>'


def parsed(spark, *pages):
    df = spark.createDataFrame([(i, f, h) for i, (f, h) in enumerate(pages)], "id int, form string, html string").repartition(2)
    return {r.id: r for r in forms.parse_forms(df, "id").collect()}


def test_fields_and_tables(spark):
    four = "<html><body><script>Issuer: no</script><table>" + cell("Reporting Person:", "Ann &amp; Bo") + cell("Issuer:", "<b>ACME</b> Inc") + cell("The Price: of it", "12.5") + "</table>"
    four += '<table class="FormData"><tr><th>a</th></tr><tr><td>Common</td><td>S</td><td>100</td><td>12.50</td><td>x</td></tr><tr><td>too</td><td>few</td></tr><tr><td>Option</td><td>P</td><td>5</td><td>1</td></tr></table><table class="FormData"><tr><td>h</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table></body>'
    sale = "<table>" + cell("Broker:", "Desk") + cell("Broker Address:", "Street") + "</table>" + '<table class="FormData"><tr><td>h</td></tr><tr><td>Common</td><td>7</td><td>D</td></tr></table>'
    got = parsed(spark, ("4", four), ("144", sale), ("25", "<p>Issuer:</p>"), ("4", None), ("NT", four), ("4", ""))
    assert got[0].fields["reporting_person"] == "Ann & Bo" and got[0].fields["issuer"] == "ACME Inc" and got[0].fields["price"] == "12.5" and got[0].fields["officer_role"] == ""
    assert got[0].lines == [{"security": "Common", "transaction_type": "S", "amount": "100", "price": "12.50"}, {"security": "Option", "transaction_type": "P", "amount": "5", "price": "1"}]
    assert got[1].fields["broker"] == "Desk" and got[1].fields["broker_address"] == "Street" and got[1].lines == [{"security_type": "Common", "amount": "7", "ownership_type": "D"}]
    assert len(got) == 6 and set(got[2].fields.values()) == {""} and set(got[3].fields.values()) == {""} and got[4].fields == {} and got[4].lines == []


def test_groups_facts_and_narrative(spark):
    eight = "<table>" + cell("Registrant:", "ACME") + cell("Event Date:", "2024-01-02") + cell("Event Description:", "A thing happened", "FormText") + "</table>"
    eight += '<div class="FormGroup"><input type="checkbox" checked><label>First</label><input type="checkbox"><label>Not</label><input type=checkbox checked=""><span><label> Second </label></span></div><div class="FormGroup small"></div>'
    ten = "<table>" + cell("Risk Factors:", "Much risk", "FormText") + cell("Management Discussion:", "We did well", "FormText") + cell("Period:", "FY") + '</table><xbrl:tag name="Revenue"> 12 </xbrl:tag><xbrl:tag name="">1</xbrl:tag><xbrl:tag name="Empty"> </xbrl:tag>'
    proxy = cell("Biography:", "Old", "FormText") + cell("Description:", "Vote", "FormText") + cell("Name:", "Cy") + '<div class="DirectorInfo"></div><div class="DirectorInfo"></div><div class="VotingMatter"></div>'
    got = parsed(spark, ("8-K", eight), ("10-K", ten), ("DEF 14A", proxy), ("11-K", cell("Auditor Report:", "Fine", "FormText")))
    assert got[0].groups == 2 and got[0].disclosures == [["First", "Second"], []] and got[0].group_fields == {"date": "2024-01-02", "description": "A thing happened"}
    assert got[0].narrative == "A thing happened A thing happened"
    assert got[1].statements == {"Revenue": "12"} and got[1].narrative == "Much risk We did well" and got[1].fields["period"] == "FY" and got[1].fields["risk_factors"] == "Much risk"
    assert got[2].narrative == "Old Old Vote" and got[2].group_fields["name"] == "Cy" and got[3].narrative == "Fine" and got[3].groups == 0


def test_sections(spark):
    p = lambda word, n: f"<p>{word} revenue grew. {'x' * n}</p>"
    page = "<nav><p>" + "revenue " * 80 + "</p></nav><h2>Item 1A. Risk Factors</h2>" + p("one", 400) + "<p>short revenue</p>" + p("two", 400) + "<h3>Sub</h3>" + p("three", 200) + "<p>annual report revenue " + "y" * 200 + "</p><h2>Other</h2>" + p("four", 900)
    page += "<h3>Competition</h3>" + p("five", 300) + "<h3>Next</h3>" + p("six", 900) + '<ix:nonnumeric name="dei:EntityRegistrantName">ACME Corporation</ix:nonnumeric>'
    long = "<h1>Results of Operations</h1>" + "".join(p(f"n{i}", 980) for i in range(8))
    plain = "<div>" + p("alone", 350) + "</div><p>nothing of interest " + "z" * 400 + "</p>"
    df = spark.createDataFrame([(1, page), (2, long), (3, plain), (4, None), (5, "<p>hi</p>")], "id int, html string")
    got = {r.id: r for r in forms.narrative(df, "id").collect()}
    first = " ".join(f"{w} revenue grew. {'x' * n}" for w, n in (("one", 400), ("two", 400), ("three", 200)))
    # The section under "Competition" is too short, and "Other" is no known heading.
    assert got[1].sections == [first] and got[1].text == f"{first} Company: ACME Corporation"
    assert len(got[2].sections) == 1 and got[2].sections[0].count("revenue") == 4 and len(got[2].text) < 10_000
    alone = f"alone revenue grew. {'x' * 350}"
    assert got[3].sections == [] and got[3].text == f"{alone} {alone}"  # the division around it counts as a paragraph, too
    assert got[4].text == "" and got[5].text == "" and got[5].sections == []


def test_pages_are_parsed_once(spark):
    """F5 of round 3: each use of a page's parts parsed all pages again."""
    df = spark.createDataFrame([(1, "<h1>Results of Operations</h1><p>" + "revenue " * 90 + "</p>")], "id int, html string")
    read = spark.sparkContext.accumulator(0)
    seen = df.withColumn("html", F.udf(lambda h: read.add(1) or h)("html"))
    out = forms.narrative(seen, "id")
    assert out.collect()[0].text.count("revenue") == 90
    assert read.value == 1
