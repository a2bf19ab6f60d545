-- where a supplier's nation lies, the supplier lies too
SELECT a.s, 'in' AS p, b.o FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = 'in' AND b.p = 'in'
