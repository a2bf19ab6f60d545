-- regions that hold a rich supplier
SELECT r.o AS s, 'rdf:type' AS p, 'RichRegion' AS o FROM triples r JOIN triples c ON c.s = r.s AND c.p = 'rdf:type' AND c.o = 'RichEuropean'
WHERE r.p = 'in' AND r.o LIKE 'region/%'
