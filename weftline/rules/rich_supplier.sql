-- suppliers in Europe with a high balance
SELECT t.s, 'rdf:type' AS p, 'RichEuropean' AS o FROM triples t
JOIN triples place ON place.s = t.s AND place.p = 'in' JOIN triples name ON name.s = place.o AND name.p = 'name' AND name.o = 'EUROPE'
WHERE t.p = 'balance' AND try_cast(t.o AS double) > 5000
