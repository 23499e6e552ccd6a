from tallyline.service import main

main()
